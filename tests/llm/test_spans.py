import random
import re

import numpy as np
import pytest

from seqlume.llm import spans


def brute(rows, span=40):
    texts = {(r, (s or "").upper()) for r, s in rows if r is not None}
    owners = {}
    for r, s in texts:
        for i in range(len(s) - span + 1):
            if re.fullmatch("[ACGT]+", s[i : i + span]):
                owners.setdefault(s[i : i + span], set()).add(r)
    shared = {}
    for r, s in texts:
        for i in range(len(s) - span + 1):
            if len(owners.get(s[i : i + span], ())) > 1:
                shared.setdefault(r, set()).update(range(i, i + span))
    found = set()
    for r, places in shared.items():
        for p in sorted(places):
            if p - 1 not in places:
                end = p
                while end in places:
                    end += 1
                found.add((r, p, end))
    return found


def run(spark, rows, **more):
    df = spark.createDataFrame([(r, s, "x", 7) for r, s in rows], "record long, sequence string, partner string, seed long")  # clashing names
    return {tuple(x) for x in spans.shared_runs(spans.chains(spans.matches(df))).collect()}


def text(rnd, n, letters="ACGT"):
    return "".join(rnd.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [text(rnd, rnd.choice([39, 40, 41, 60, 200])) for _ in range(6)] + ["A" * 70, "ACACAC" * 15]
    rows = [(None, text(rnd, 80)), (900, None), (901, ""), (902, "ACGT")]
    for i in range(40):
        s = text(rnd, rnd.randint(0, 90)) + rnd.choice(pool) + text(rnd, rnd.randint(0, 50), "ACGTN") + rnd.choice(pool)
        rows.append((i, "".join(c.lower() if rnd.random() < 0.1 else c for c in s)))
    rows += [rows[10], rows[11], (500, rows[12][1]), (501, rows[12][1])]
    assert run(spark, rows) == brute(rows)


def test_one_record_twice_is_not_shared(spark):
    rnd = random.Random(4)
    s = text(rnd, 100)
    assert run(spark, [(1, s), (1, s), (2, s[:39])]) == set()
    assert run(spark, [(1, s + s)]) == set()


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_hot_content_stays_linear(spark, monkeypatch):
    from seqlume.plans import skew

    rnd = random.Random(5)
    hot, other = text(rnd, 120), text(rnd, 50)
    rows = [(i, hot) for i in range(300)] + [(1000 + i, text(rnd, 120) + (other if i < 2 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "record long, sequence string")
    linked = spans.matches(df)
    assert 300 * 81 + 2 * 11 <= linked.count() <= 300 * 81 + 2 * 14  # neighbours may agree by chance
    monkeypatch.setattr(skew, "small", lambda d, n=0: False)
    assert run(spark, rows) == brute(rows)


def test_long_reads_are_cut_without_loss(spark, monkeypatch):
    rnd = random.Random(6)
    shared = text(rnd, 500)
    rows = [(1, text(rnd, 3900) + shared + text(rnd, 4000)), (2, shared)]
    df = spark.createDataFrame(rows, "record long, sequence string")
    monkeypatch.setattr(spans, "CHUNK", 1000)
    whole = brute(rows)
    assert {tuple(x) for x in spans.shared_runs(spans.chains(spans.matches(df))).collect()} == whole == {(1, 3900, 4400), (2, 0, 500)}


def test_packing():
    rnd = random.Random(7)
    code = np.array([rnd.randrange(4) for _ in range(100)], np.uint8)
    for size in (1, 5, 20, 31, 32):
        packed = spans._packed(code, size)
        for i in range(100 - size):
            assert int(packed[i]) == sum(int(c) << 2 * (size - 1 - j) for j, c in enumerate(code[i : i + size]))
    head, tail = spans._packed(code, 32)[:1].repeat(41), spans._packed(code, 32)[28:29].repeat(41)
    want = [int(x) for x in spans._packed(code, 20)[:41]]
    assert [int(x) for x in spans._twenty(head, tail, np.arange(41))] == want
    x = np.array([rnd.randrange(1000) for _ in range(200)])
    assert spans._sliding_min(x, 21)[:180].tolist() == [int(min(x[i : i + 21])) for i in range(180)]


def test_chain_follows_order_and_counts_gaps():
    assert spans.chain([(0, 0, 40), (50, 50, 40), (100, 98, 40)]) == [0, 0, 0]
    crossing = spans.chain([(0, 100, 40), (50, 0, 40)])
    assert crossing[0] != crossing[1]
    far = spans.chain([(0, 0, 40), (5000, 5000, 40)])
    assert far[0] != far[1]
    rnd = random.Random(8)
    for _ in range(50):  # scores against all predecessors
        segments = [(rnd.randrange(300), rnd.randrange(300), 40) for _ in range(12)]
        names = spans.chain(segments)
        assert len(names) == 12 and min(names) == 0
        for name in set(names):
            own = sorted(s for s, n in zip(segments, names, strict=True) if n == name)
            assert all(a[0] + 40 <= b[0] and a[1] + 40 <= b[1] for a, b in zip(own, own[1:], strict=False))


def test_fenwick():
    tree = spans.Fenwick(10)
    tree.put(3, (5.0, 1))
    tree.put(7, (9.0, 2))
    assert tree.before(3)[1] == -1 and tree.before(4) == (5.0, 1) and tree.before(10) == (9.0, 2)


def test_passages_align_the_gaps(spark):
    rnd = random.Random(9)
    a, b = text(rnd, 60), text(rnd, 60)
    rows = [(1, text(rnd, 30) + a + "A" + b), (2, a + "C" + b + text(rnd, 10)), (3, text(rnd, 200))]
    df = spark.createDataFrame(rows, "record long, sequence string")
    got = {r.record: r for r in spans.passages(df, spans.chains(spans.matches(df))).collect()}
    assert set(got) == {1, 2} and got[1].segments == 2 and got[1].edits == 1 and got[1].exact == 120 and (got[1].start, got[1].end) == (30, 151)
    assert spans._edits("kitten", "sitting") == 3 and spans._edits("", "ab") == 2


def test_fuzzy_passages_link_all_different_texts(spark, monkeypatch):
    rnd = random.Random(10)
    a, b = text(rnd, 60), text(rnd, 60)
    rows = [(1, text(rnd, 30) + a + text(rnd, 30)), (2, a + "A" + b), (3, text(rnd, 20) + a + "C" + b), (4, a + "A" + b), (5, text(rnd, 10) + a + text(rnd, 400)), (None, a), (6, None), (7, a + a), (7, a + a)]
    df = spark.createDataFrame(rows, "record long, sequence string")
    for block in (1, 1000):
        monkeypatch.setattr(spans, "BLOCK_TEXTS", block)
        got = {(r.record, r.partner): r for r in spans.fuzzy_passages(df).collect()}
        for pair in ((2, 3), (3, 2)):
            assert got[pair].edits == 1 and got[pair].exact == 120 and got[pair].segments == 2
        assert (got[3, 2].start, got[3, 2].end, got[3, 2].there, got[3, 2].there_end) == (20, 141, 0, 121)
        assert got[4, 2].exact == 121 and got[2, 4].exact == 121  # copies stand for each other
        assert (1, 2) in got and (3, 1) in got and (5, 1) in got and (7, 1) in got
        assert all(x != y for x, y in got) and not {r for r, _ in got} & {6, None}
    assert spans.fuzzy_passages(df.where("false")).count() == 0


@pytest.mark.parametrize("stretch", [20, 25, 39])
def test_fuzzy_passages_without_a_whole_window(spark, stretch):
    rnd = random.Random(stretch)
    parts = [text(rnd, stretch) for _ in range(6)]
    rows = [(1, text(rnd, 30) + "A".join(parts)), (2, "C".join(parts)), (3, text(rnd, 50) + parts[0][:20])]
    df = spark.createDataFrame(rows, "record long, sequence string")
    got = {(r.record, r.partner): r for r in spans.fuzzy_passages(df).collect()}
    assert (got[1, 2].segments, got[1, 2].exact, got[1, 2].edits) == (6, 6 * stretch, 5)
    assert (got[2, 1].start, got[2, 1].end) == (0, 6 * stretch + 5)
    assert (3, 2) in got and (3, 1) in got


@pytest.mark.parametrize("chunk,bits", [(300, 22), (10**6, 22), (2000, 12)])
def test_repeated_places_are_all_found(spark, monkeypatch, chunk, bits):
    monkeypatch.setattr(spans, "CHUNK", chunk)
    monkeypatch.setattr(spans, "PIECE_BITS", bits)
    rnd = random.Random(12)
    hot, parts = text(rnd, 30), [text(rnd, 25) for _ in range(5)]
    sequences = [text(rnd, rnd.randint(20, 200)) + (hot if i % 3 == 0 else rnd.choice(parts)) + "N" + text(rnd, rnd.randint(0, 60)) for i in range(80)] + ["A" * 90, "N" * 30, hot, text(rnd, 5000) + hot]
    texts = spans._numbered(spark.createDataFrame([(s,) for s in sequences], "sequence string").repartition(3), "texts")
    where = {}
    for r in texts.collect():
        for i in range(len(r.sequence) - 19):
            if re.fullmatch("[ACGT]+", r.sequence[i : i + 20]):
                where.setdefault(r.sequence[i : i + 20], []).append((r.text, i))
    want = {p for places in where.values() if len(places) > 1 for p in places}
    rows = spans.repeated_places(texts).collect()
    got = {(r.text, r["at"]) for r in rows}
    assert len(rows) == len(got) and want <= got and len(got - want) < 0.05 * sum(map(len, where.values()))
    assert spans.repeated_places(texts.where("false")).count() == 0


def test_numbers_packed():
    rnd = random.Random(13)
    for top in (1, 200, 70_000, 1 << 22):
        values = np.sort(np.array([rnd.randrange(top) for _ in range(500)], np.int64))
        width, packed = spans._pack(values)
        assert (spans._unpack(500, width, packed) == values).all()
