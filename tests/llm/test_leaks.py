import pytest

from pyspark.sql import functions as F

from seqlume.llm import leaks

ITEM = "According to the zork table, every plum with a soft core must lose exactly 384 grams of brill today."
OTHER = "Explain in one short sentence how the klee rule separates a robust controller from a weak one again."


def items(spark, rows=None):
    # Several items of one template, so that its own words are known.
    more = [(10 + i, f"According to the {n} table, every {n}x with a {n}y core must lose exactly {i} grams of {n}z today.") for i, n in enumerate(["foo", "bar", "baz", "qux"])]
    return spark.createDataFrame(rows if rows is not None else [(1, ITEM), (2, OTHER), (3, ITEM), (4, "too short"), (5, None), (6, ""), (None, ITEM), *more], "item_id int, text string")


CASES = [
    (ITEM, {1, 3}), (ITEM.upper().replace(",", " --"), {1, 3}), (" ".join(ITEM.split()[:12]), {1, 3}), (" ".join(ITEM.split()[:11]), set()), (" ".join(ITEM.split()[:11] + ["more"]), set()),
    ("% According to the zork table,\n% every plum with a\n% soft core must lose", {1, 3}), (r"{\em According} to \textbf{the} zork~table, {\bf every\/} plum with a soft \emph{core} must lose exactly", {1, 3}),
    (r"According to the z\textit{ork} table, every pl{\-}um with a soft core must lose", {1, 3}), ("Ａccording tо the zork table, every plu​m with a soﬁt core must lose".replace("ﬁ", "f"), {1, 3}),
    ("According to the zork table, every plum with a NEW soft core must lose exactly 384 grams of brill today", set()), (None, set()), ("", set()), ("  \n ", set()),
    ("x " * 300_000 + OTHER + " y" * 300_000, {2}), (OTHER + " " + ITEM, {1, 2, 3}), (r"According\\to the zork table, every plum with a soft core must lose", {1, 3}),
]


def test_verbatim(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0], "x"), (None, ITEM, "x")], "doc_id long, text string, template string")
    found = [tuple(r) for r in leaks.verbatim(docs, items(spark)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(i, item) for i, (_, own) in enumerate(CASES) for item in own}


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_blocks_of_items(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_WINDOWS", block)
    docs = spark.createDataFrame([(1, ITEM), (2, OTHER)], "doc_id long, text string")
    assert {tuple(r) for r in leaks.verbatim(docs, items(spark, [(1, ITEM), (2, OTHER)])).collect()} == {(1, 1), (2, 2)}


def test_reparameterised(spark):
    docs = spark.createDataFrame([
        (1, "According to the glim table, every pear with a hard core must lose exactly 12 grams of whey today."), (2, ITEM), (3, "According to the same table, every same with a same core must lose exactly 12 grams of same today."), (4, "nothing at all"),
    ], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.reparameterised(docs, items(spark)).collect()}
    assert got == {(1, 1)}  # 2 is verbatim, 3 repeats one name where items have several


def test_reparameterised_tests_every_wording(spark):
    # Item 0 has one name where the others have several: same templates, other slots.
    first = "According to the kip table, every kip with a kip core must lose exactly 7 grams of kip today."
    known = items(spark).unionByName(spark.createDataFrame([(0, first)], "item_id int, text string"))
    docs = spark.createDataFrame([
        (1, "According to the glim table, every pear with a hard core must lose exactly 12 grams of whey today."), (2, first), (3, "According to the same table, every same with a same core must lose exactly 12 grams of same today."),
    ], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.reparameterised(docs, known).collect()} == {(1, 1), (3, 0)}
    assert {(r.doc_id, r.item_id) for r in leaks.reparameterised(docs, known, every=True).collect()} == {(1, i) for i in (1, 3, 10, 11, 12, 13)} | {(3, 0)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert leaks.verbatim(docs.where("false"), items(spark)).count() == 0
    assert leaks.verbatim(docs, items(spark, [])).count() == 0
    assert leaks.reparameterised(docs, items(spark, [])).count() == 0


def test_words():
    assert leaks.words_of("The {C}afе́ \\emph{x}-y\\\\z \\alpha_2") == ["the", "café", "x", "y", "z", "2"]
    assert leaks.words_of(None) == []


def test_items_without_common_words_emit_no_windows(spark):
    names = iter(f"w{i:05d}x" for i in range(10**6))
    few = spark.createDataFrame([(i, " ".join(next(names) for _ in range(20))) for i in range(40)], "item_id int, text string")
    docs = spark.createDataFrame([(i, " ".join(next(names) for _ in range(200))) for i in range(100)], "doc_id long, text string")
    for by, least in (("wording", 0), ("pattern", 5)):
        assert leaks.candidates(docs, few, by, least)[0].count() == 0
    assert leaks.verbatim(docs.unionByName(few.select(F.col("item_id").cast("long").alias("doc_id"), "text")), few).count() == 40


def test_recall_of_planted_reparameterised_items(spark, data):
    known = spark.read.parquet(f"{data}/eval_items.parquet")
    vocabulary = [r.word for r in leaks.shared_words(known).collect()]
    codes = leaks._Codes(vocabulary)
    fixed = {w for w in vocabulary if not codes.typed(w)}
    planted, items_of = [], {}
    for r in known.orderBy("item_id").collect():
        words = leaks.words_of(r.text)
        if any(sum(w in fixed for w in words[i : i + 12]) >= 5 for i in range(len(words) - 11)):
            other = [w if w in fixed or w in leaks.UNITS else f"7{w}8" if codes.typed(w) else f"z{w}z" for w in words]
            if other != words:
                planted.append((r.item_id, "Some words before. " + " ".join(other) + " And after."))
                items_of[r.item_id] = r.text
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks.reparameterised(docs, known, every=True).collect()}
    assert len(planted) > 50
    hit = sum((i, i) in found for i in items_of)
    print(f"recall {hit} of {len(planted)}")
    assert hit == len(planted)
