import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlume.llm import digest


def made(values):
    return digest.merge(np.zeros(len(values), np.int64), {"means": values, "weights": np.ones(len(values)), "mixed": np.zeros(len(values), np.int32)})[1]


@pytest.mark.parametrize("name", ["normal", "ties", "heavy", "sorted", "same", "few"])
def test_rank_error_after_merges(name):
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=100_000), "ties": rng.choice([51.0, 100.0, 149.0, 150.0], 100_000, p=[0.1, 0.1, 0.2, 0.6]), "heavy": np.exp(rng.normal(size=100_000) * 4),
        "sorted": np.arange(100_000.0), "same": np.full(5_000, 7.0), "few": rng.random(50),
    }[name]
    parts = [made(p) for p in np.array_split(values, 23)]
    whole = digest.merge(np.zeros(sum(len(p["means"]) for p in parts), np.int64), {k: np.concatenate([p[k] for p in parts]) for k in digest.FIELDS})[1]
    assert len(whole["means"]) <= digest.SIZE / 2 + 2 and whole["weights"].sum() == pytest.approx(len(values))
    ordered = np.sort(values)
    for q in (0.001, 0.01, 0.25, 0.5, 0.9, 0.99):
        v = digest.quantile(whole["means"], whole["weights"], whole["mixed"], q)
        low, high = np.searchsorted(ordered, v) / len(ordered), np.searchsorted(ordered, v, "right") / len(ordered)
        assert max(0, low - q, q - high) <= digest.rank_error(q) + 1 / len(ordered)


def rows(spark, extra=()):
    rng = np.random.default_rng(2)
    data = [("a", float(v)) for v in rng.normal(100, 10, 3000)] + [("b", float(v)) for v in rng.integers(0, 5, 3000)] + [(None, 4.0)] * 3 + [("a", None), ("c", None), ("a", math.nan), *extra]
    return spark.createDataFrame([(g, v, 1) for g, v in data], "g string, v double, means int").repartition(5)


def test_groups_certified_by_counting(spark):
    df, sets = rows(spark), [[], ["g"]]
    wanted = {"median": 0.5, "p99": 0.99}
    found = digest.percentiles(digest.digests(df, F.col("v"), ["g"], sets), wanted)
    got = {(r.grouping, r.g): r for r in digest.certified(found, df, F.col("v"), ["g"], sets, wanted).collect()}
    assert set(got) == {("", None), ("g", "a"), ("g", "b"), ("g", None)}
    assert got["", None].total == 6003 and got["g", None].median == 4.0
    assert all(r.median_rank_error <= digest.rank_error(0.5) and r.p99_rank_error <= digest.rank_error(0.99) for r in got.values())


def test_stored_days_combine(spark):
    df = rows(spark)
    parts = digest.digests(df, F.col("v"), ["g"], [["g"]])
    again = digest.percentiles(digest.merged(parts.unionByName(parts), ["g"]), {"median": 0.5})
    once = digest.percentiles(parts, {"median": 0.5})
    a, b = {r.g: r for r in again.collect()}, {r.g: r for r in once.collect()}
    assert all(a[g].total == 2 * b[g].total and abs(a[g].median - b[g].median) < 1 for g in a)


def test_weights(spark):
    df = spark.createDataFrame([(10, 10), (20, 20), (30, 30), (0, 0)], "v int, w int")
    found = digest.percentiles(digest.digests(df, F.col("v"), [], [[]], F.col("w")), {"n50": 0.5}).first()
    assert found.n50 == 30 and found.total == 60


@pytest.mark.parametrize("sizes", [[10, 10, 20], [10, 30], [5], [7, 7], [1, 2, 3, 4, 100], list(range(1, 60)), [150] * 40 + [51] * 3])
def test_n50_follows_its_rule(spark, sizes):
    so_far, want = 0, None
    for n in sorted(sizes):
        so_far += n
        if want is None and so_far >= sum(sizes) // 2:
            want = n
    df = spark.createDataFrame([(n,) for n in sizes], "v int")
    found = digest.percentiles(digest.digests(df, F.col("v"), [], [[]], F.col("v")), {"n50": 0.5}, whole=True, reach=True)
    row = digest.certified(found, df, F.col("v"), [], [[]], {"n50": 0.5}, F.col("v"), True).first()
    assert row.n50 == want and row.n50_rank_error == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert digest.percentiles(digest.digests(df, F.col("v"), ["g"], [["g"], []]), {"m": 0.5}).count() == 0
