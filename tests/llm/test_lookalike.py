import random
import unicodedata

import pytest

from seqlume.llm import lookalike

SAME = [
    ("plain text", "рlаin tехt"), ("wide 12", "ｗｉｄｅ １２"), ("café", "café"), ("zero width", "ze​ro­ wi﻿dth"), ("a b", "a b"), ("a b", "a b"), ("office fl", "oﬃce ﬂ"), ("a-b", "a‑b"), ("a-b", "a‐b"),
    ("й ё", "й ё"), ("сон снег", "coн cнeг"), ("hi!", "hі！"), ("≠", "≠"), ("é", "е́"), ("Ωmega", "Ωmega"), ("a, b", "a， b"), ("ǆ", "dž"),
]
DIFFERENT = [("cafe", "café"), ("x2", "x²"), ("A", "a"), ("a b", "a  b"), ("a\nb", "a b"), ("a—b", "a-b"), ("\\emph{a}", "a"), ("ſ", "s"), ("l", "1"), ("сон", "son")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert a != b and lookalike.by_table(a) == lookalike.by_table(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_visible_differences(a, b):
    assert lookalike.by_table(a) != lookalike.by_table(b)


def test_table_is_idempotent():
    for code in lookalike.TABLE:
        once = lookalike.by_table(chr(code))
        assert lookalike.by_table(once) == once
    for code in range(0x80, 0x3000):
        once = lookalike.by_table(chr(code))
        assert lookalike.by_table(once) == once and unicodedata.is_normalized("NFC", once)


def test_folding_by_runs_equals_folding_whole():
    rnd = random.Random(3)
    letters = [*"ae o-\n", *lookalike.LOOK_ALIKE, "\u0301", "\u0308", "\u0323", "\u200b", "\u034f", "\u0338", "=", "é", "ё", "ﬁ", "Ａ", "\u1100", "\u1161", "\u11a8", "中", "\u00a0"]
    for _ in range(20_000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12)))
        assert lookalike.by_table(text) == lookalike._fold(text, lookalike.TABLE)
        assert lookalike.rewrite(text, {}) == lookalike._fold(text, lookalike.TABLE)


def test_trie_walks_look_alikes_for_free():
    trie = lookalike.Trie({"paypal": 5, "снег": 3, "office": 2, "café": 1, "cafe": 9})
    assert trie.search("раураl") == [(0, "paypal", 5)] and trie.search("oﬃce") == [(0, "office", 2)] and trie.search("pay​pal") == [(0, "paypal", 5)]
    assert trie.search("cнeг") == [(0, "снег", 3)] and trie.search("cafе́") == [(0, "café", 1)] and trie.search("nothing") == []
    near = lookalike.Trie({"paypal": 5, "payroll": 1}, 1)
    assert near.search("paypa") == [(1, "paypal", 5)] and near.search("раyраll") == [(1, "paypal", 5)] and near.search("xaypol") == []


def pairs(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, canonical string")
    got = [tuple(r) for r in lookalike.same_look(df, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute(texts):
    shown = [(i, t, lookalike.by_table(t)) for i, t in texts if t is not None and i is not None and lookalike.by_table(t).strip()]
    return {(a, b) for a, t, f in shown for b, u, g in shown if a < b and f == g and t != u}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_pairs(spark, limit):
    texts = [(i, t) for i, t in enumerate([x for p in SAME for x in p] + [x for p in DIFFERENT for x in p] + [None, "", " ", "​", " ", "plain text", "рlаin tехt"])]
    texts += [(None, "plain text"), (900, "z" * 500_000 + "е"), (901, "z" * 500_000 + "e")]
    assert pairs(spark, texts, broadcast_tokens=limit) == brute(texts)
    assert (900, 901) in brute(texts)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_random_variants(spark, limit):
    rnd = random.Random(1)
    swap = {}
    for source, to in lookalike.LOOK_ALIKE.items():
        swap.setdefault(to, []).append(source)
    base = ["сон и снег", "the open office", "вёсны ещё", "copa área", "сор cop сор", "Москва метро", "x-ray-y"]
    texts = []
    for i in range(150):
        t = "".join(rnd.choice(swap[c]) if c in swap and rnd.random() < 0.3 else c + ("​" if rnd.random() < 0.05 else "") for c in rnd.choice(base))
        texts.append((i, unicodedata.normalize(rnd.choice(["NFC", "NFD"]), t)))
    assert pairs(spark, texts, broadcast_tokens=limit) == brute(texts)


def test_canonical_spelling_comes_from_the_vocabulary(spark):
    texts = [(1, "снег сон"), (2, "cнeг coн"), (3, "снег"), (4, None), (5, ""), (6, "zzп̧о")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.canonical for r in lookalike.canonical(df).collect()}
    assert got[1] == got[2] == "снег сон" and got[3] == "снег" and got[4] is None and got[5] == ""


def test_empty_table(spark):
    assert pairs(spark, []) == set()


def test_tries_and_table_disagree(spark):
    # A palochka is read as I by the table; the vocabulary knows the word with l.
    texts = [(1, "hello hello world"), (2, "heӀӀo world"), (3, "heІІo"), (4, "Iong"), (5, "Ӏong"), (6, "long"), (7, "xӀx"), (8, "he​ІIo")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.canonical for r in lookalike.canonical(df).collect()}
    assert lookalike.by_table("heӀӀo") == "heIIo" and got[2] == "hello world" and got[3] == got[8] == "hello"
    assert got[5] == "Iong"  # the first reading is in the vocabulary, so it wins
    assert got[7] == "xIx"  # in no vocabulary: by table
    by_table_only = {r.doc_id: r.canonical for r in lookalike.canonical(df, budget=0).collect()}
    assert by_table_only[2] == "heIIo world"


@pytest.mark.parametrize("words", [1, 3, 10**6])
def test_edits_meet_every_word(spark, monkeypatch, words):
    monkeypatch.setattr(lookalike, "TRIE_WORDS", words)
    df = spark.createDataFrame([(t, 1) for t in ("paypal", "office", "zebra", "рayрol", "оffce", "ѕebra", "рaypаl")], "token string, n long")
    got = {r.token: (r.spelling, r.known) for r in lookalike.spellings(df, budget=1).collect()}
    assert got == {"рayрol": ("paypal", True), "оffce": ("office", True), "ѕebra": ("zebra", True), "рaypаl": ("paypal", True)}


def test_classes(spark):
    texts = [(1, "cop"), (2, "сор"), (3, "cop"), (4, "other"), (5, None), (6, " "), (None, "cop"), (7, "сoр")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in lookalike.looks_alike(df).collect()}
    assert got == {(1, 1, 4, 3), (2, 1, 4, 3), (3, 1, 4, 3), (7, 1, 4, 3), (4, 4, 1, 1)}
    assert lookalike.looks_alike(df.where("false")).count() == 0


def test_long_tokens_go_by_table(spark):
    texts = [(1, "e" * 101), (2, "е" * 101), (3, "е" * 101 + "​")]
    assert pairs(spark, texts) == {(1, 2), (1, 3), (2, 3)}
