import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqlume.llm import distinct


def states(hashes):
    items = distinct.lift(pa.array(hashes.view(np.int64)))
    return distinct.merge(np.zeros(len(hashes), np.int64), items)[1]


@pytest.mark.parametrize("n", [0, 1, 30, 1000, 20_000, 300_000])
def test_error_is_as_stated(n):
    rng = np.random.default_rng(n)
    errors = []
    for _ in range(12):
        s = states(rng.integers(0, 2**64, n, dtype=np.uint64))
        errors.append(distinct.estimates(np.zeros(len(s["states"]), np.int64), s["states"], 1)[0] - n)
    assert np.sqrt(np.mean(np.square(errors))) <= 2 * distinct.standard_error() * n + 1e-6


def test_merging_is_lossless():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    whole = states(hashes)
    parts = [states(p) for p in np.array_split(hashes, 7)]
    joined = {k: np.concatenate([p[k] for p in parts]) for k in whole}
    merged = distinct.merge(np.zeros(len(joined["states"]), np.int64), joined)[1]
    assert all((merged[k] == whole[k]).all() for k in whole)


def test_groups_nulls_repeats_and_unions(spark):
    rnd = random.Random(1)
    rows = [(d, None if rnd.random() < 0.1 else "ab"[i % 2], str(rnd.randint(0, 400)) if rnd.random() < 0.95 else None, "x") for i in range(4000) for d in [i % 3]]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "day int, g string, v string, states string").repartition(7)
    sets = [[], ["day"], ["g"], ["day", "g"]]
    sketch = distinct.sketches(df, F.col("v"), ["day", "g"], sets)
    got = {(r.grouping, r.day, r.g): r.distinct for r in distinct.estimate(sketch).collect()}
    want = {}
    for d, g, v, _ in rows:
        if v is not None:
            for name, key in (("", (None, None)), ("day", (d, None)), ("g", (None, g)), ("day,g", (d, g))):
                want.setdefault((name, *key), set()).add(v)
    assert set(got) == set(want)
    assert all(abs(got[k] - len(v)) <= 0.05 * len(v) + 0.5 for k, v in want.items())
    days = distinct.estimate(distinct.merged(sketch.where("grouping = 'day,g'"), ["g"])).collect()
    assert all(abs(r.distinct - len(want["g", None, r.g])) <= 0.05 * 400 for r in days) and len(days) == 3
    assert all(r.distinct == got["g", None, r.g] for r in days)


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, v string")
    assert distinct.estimate(distinct.sketches(df, F.col("v"), ["g"], [[], ["g"]])).count() == 0


def test_empty_and_long_values(spark):
    df = spark.createDataFrame([("", "a"), ("x" * 1_000_000, "a"), ("x" * 1_000_000, "a")], "v string, g string")
    assert round(distinct.estimate(distinct.sketches(df, F.col("v"), ["g"], [["g"]])).first().distinct, 2) == 2


def test_partials_leave_a_full_worker(spark, monkeypatch):
    from seqlume.llm import grouped

    df = spark.range(30_000).select((F.col("id") % 5).alias("g"), F.col("id").alias("v"))
    monkeypatch.setattr(grouped, "HELD_ITEMS", 100)
    for r in distinct.estimate(distinct.sketches(df, F.col("v"), ["g"], [["g"], []])).collect():
        assert abs(r.distinct - (30_000 if r.g is None else 6_000)) < 1_000


def test_parts_are_merged_group_by_group(spark, monkeypatch):
    from seqlume.llm import grouped

    monkeypatch.setattr(grouped, "HELD_ITEMS", 50)
    rows = spark.range(3000).select((F.col("id") % 40).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("h"), F.col("id").cast("string").alias("v"), F.col("id").alias("part"))
    parts = None
    for i in range(3):
        one = distinct.sketches(rows.where(f"part % 3 = {i}"), F.col("v"), ["g", "h"], [["g", "h"]])
        parts = one if parts is None else parts.unionByName(one)
    whole = {(r.g, r.h): (sorted(zip(r.registers, r.states))) for r in distinct.sketches(rows, F.col("v"), ["g", "h"], [["g", "h"]]).collect()}
    got = distinct.merged(parts, ["g", "h"]).collect()
    assert len(got) == len(whole) and {(r.g, r.h): sorted(zip(r.registers, r.states)) for r in got} == whole
