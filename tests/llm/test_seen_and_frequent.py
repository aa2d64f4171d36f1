import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlume.llm import frequent, seen


def brute(rows, prior):
    known = {k.upper() for k in prior if k}
    found = set()
    first = {}
    for at, k in rows:
        if at is not None and k:
            first[k.upper()] = min(first.get(k.upper(), at), at)
    for at, k in rows:
        if at is not None and k and (k.upper() in known or at > first[k.upper()]):
            found.add(at)
    return found


def run(spark, rows, prior, parts=5, **options):
    df = spark.createDataFrame([(a, k, "x") for a, k in rows], "read_idx long, sequence string, hash string").repartition(parts)
    p = spark.createDataFrame([(k,) for k in prior], "sequence string")
    repeats, errors = seen.verdicts(df, F.upper("sequence"), "read_idx", p, F.upper("sequence"), **options)
    got = [r[0] for r in repeats.collect()]
    assert len(got) == len(set(got))
    return set(got), errors.first()


def data(seed, n=3000):
    rnd = random.Random(seed)
    keys = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 12))) for _ in range(n // 2)] + ["x" * 300_000]
    rows = [(i, rnd.choice(["acgt", "ACGT", None, "", *keys[:1200]]) if rnd.random() < 0.6 else rnd.choice(keys)) for i in range(n)]
    rnd.shuffle(rows)
    return rows + [(None, "ACGT")], [rnd.choice(keys) for _ in range(50)] + [None, "", "acgt"]


@pytest.mark.parametrize("bits", [10, 1])
def test_every_verdict_is_right(spark, bits):
    rows, prior = data(1)
    got, errors = run(spark, rows, prior, bits_per_key=bits)
    assert got == brute(rows, prior)
    assert errors["keys"] == sum(bool(k) and a is not None for a, k in rows) and errors.repeats == len(got)
    assert errors.accepted >= errors.repeats and errors.disproved == errors.accepted - errors.repeats and errors.false_negative_rate == 0


def test_a_starved_filter_errs_and_says_so(spark, monkeypatch):
    monkeypatch.setattr(seen, "STEP", 16)
    rows = [(i, f"k{i}") for i in range(30_000)]
    got, errors = run(spark, rows, [], bits_per_key=1)
    assert got == set() and errors.disproved > 0 and errors.false_positive_rate == pytest.approx(errors.disproved / 30_000)


def test_hot_keys_without_broadcast(spark, monkeypatch):
    from seqlume.plans import skew

    monkeypatch.setattr(skew, "small", lambda d, n=0: False)
    rows = [(i, "HOT" if i % 3 == 0 else f"k{i % 700}") for i in range(3000)]
    got, _ = run(spark, rows, ["hot"])
    assert got == brute(rows, ["hot"])


def test_no_prior_and_empty(spark):
    got, errors = run(spark, [], [])
    assert got == set() and errors["keys"] == 0 and errors.false_positive_rate == 0
    df = spark.createDataFrame([(1, "A"), (2, "a")], "read_idx long, sequence string")
    assert [r[0] for r in seen.verdicts(df, F.upper("sequence"), "read_idx")[0].collect()] == [2]


def test_rows_of_one_number_arrive_together(spark):
    got, _ = run(spark, [(5, "A"), (5, "A"), (6, "A"), (4, "B")], [])
    assert got == {6}


@pytest.mark.parametrize("bits", [64, 1 << 12, (1 << 20) + 9])
def test_bloom_has_no_false_negatives(bits):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 500, dtype=np.uint64)
    bloom = seen.Bloom(bits)
    assert not bloom.holds(keys).any()
    bloom.add(keys)
    assert bloom.holds(keys).all()
    if bits > 1 << 20:
        assert bloom.holds(rng.integers(0, 2**64, 5000, dtype=np.uint64)).mean() < 0.01


@pytest.mark.parametrize("share,buckets", [(0.05, 1 << 16), (0.01, 64), (0.02, 1), (1.0, 8)])
def test_iceberg(spark, share, buckets):
    rnd = random.Random(2)
    rows = [rnd.choice([None, "", "a", "a", "b", "y" * 100_000 if i % 500 == 0 else "c", f"k{rnd.randint(0, 60)}", f"u{i}"]) for i in range(5000)]
    df = spark.createDataFrame([(r, 1) for r in rows], "value string, n int").repartition(6)
    counts = collections.Counter(r for r in rows if r)
    total = sum(counts.values())
    got = {r.value: r.n for r in frequent.iceberg(df, F.col("value"), share, buckets=buckets).collect()}
    assert got == {k: n for k, n in counts.items() if n >= share * total}


def test_iceberg_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("",)], "value string")
    assert frequent.iceberg(df, F.col("value"), 0.01).count() == 0
    assert frequent.iceberg(df.where("false"), F.col("value"), 0.01).columns == ["value", "n", "share"]
    with pytest.raises(ValueError):
        frequent.iceberg(df, F.col("value"), 0)


def test_filter_is_sized_by_earlier_keys_too(spark):
    # Few new keys against many earlier ones: the filter errs in about one of a hundred.
    prior = spark.range(400_000).select(F.concat(F.lit("p"), "id").alias("sequence"))
    rows = spark.range(2_000).select(F.col("id").alias("read_idx"), F.concat(F.lit("n"), "id").alias("sequence"))
    repeats, errors = seen.verdicts(rows, F.col("sequence"), "read_idx", prior, F.col("sequence"))
    got = errors.first()
    assert repeats.count() == 0 and got.accepted == got.disproved and got.false_positive_rate < 0.03 and got.missed == 0


def test_disproved_rows_are_logged(spark, monkeypatch):
    monkeypatch.setattr(seen, "STEP", 16)
    rows = spark.createDataFrame([(i, f"k{i % 9_000}") for i in range(10_000)], "read_idx long, sequence string")
    found = seen.judged(rows, F.col("sequence"), "read_idx", bits_per_key=1)
    logged, errors = {r.read_idx for r in found.disproved.collect()}, seen.rates(found, "read_idx").first()
    assert found.repeats.count() == 1_000 and errors.missed == 0 and errors.false_negative_rate == 0
    assert len(logged) == errors.disproved > 100 and max(logged) < 9_000


def test_missed_repeats_are_measured(spark):
    rows = spark.createDataFrame([(i, f"k{i % 50}") for i in range(100)], "read_idx long, sequence string")
    found = seen.judged(rows, F.col("sequence"), "read_idx")
    found.clear = found.clear.where("at < 60")  # as if the filter had lost the others
    errors = seen.rates(found, "read_idx").first()
    assert errors.missed == 40 and errors.false_negative_rate == pytest.approx(0.8)


def test_days_share_what_is_remembered(spark, monkeypatch):
    monkeypatch.setattr(seen, "SHARD_BITS", 1 << 12)
    earlier = seen.remember(spark.createDataFrame([(f"k{i % 700}",) for i in range(1_000)] + [(None,), ("",)], "k string"), F.col("k"), room=1_000)
    assert earlier.keys.count() == 700 and earlier.filters.count() <= earlier.shards
    for day in range(2):
        rows = spark.createDataFrame([(i, f"k{i + 500 * day}") for i in range(600)], "read_idx long, sequence string")
        repeats, _ = seen.verdicts(rows, F.col("sequence"), "read_idx", earlier=earlier)
        assert {r[0] for r in repeats.collect()} == {i for i in range(600) if i + 500 * day < 700}


def test_a_full_map_of_asked_hashes_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(seen, "MOST_ASKED_BITS", 128)
    rows, prior = data(3)
    assert run(spark, rows, prior)[0] == brute(rows, prior)


def test_keys_that_share_a_hash(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(seen.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(40)))
    rows, prior = data(4, 600)
    got, errors = run(spark, rows, prior)
    assert got == brute(rows, prior) and errors.disproved > 0


def test_buckets_follow_the_share(spark):
    df = spark.range(200_000).select(F.when(F.col("id") < 20, "often").otherwise(F.concat(F.lit("k"), "id")).alias("value"))
    assert [tuple(r)[:2] for r in frequent.iceberg(df, F.col("value"), 0.00005).collect()] == [("often", 20)]
    with pytest.raises(ValueError, match="at least"):
        frequent.iceberg(df, F.col("value"), 1e-9)
