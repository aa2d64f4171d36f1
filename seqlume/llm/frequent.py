"""The most frequent values of a column, by iceberg filtering with several hashes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.plans.scratch import materialise

HASHES = 3
#: Buckets of a hash: at least and at most.  Where all values are rare, a bucket holds an eighth of the threshold.
BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 22


def iceberg(rows: DataFrame, key: Column, share: float, hashes: int = HASHES, buckets: int | None = None) -> DataFrame:
    """``value``, ``n`` and ``share`` of every value that makes up ``share`` of the rows or more.

    Null and empty keys are neither counted nor part of the total.  First pass:
    exact counts of ``buckets`` coarse buckets under each hash, summed before the
    shuffle, so at most hashes x buckets rows leave a task.  At most 1 / share
    buckets of a hash can reach the threshold.  Second pass: values that have a
    heavy bucket under every hash are counted exactly.  No frequent value is
    missed and every count is exact; the hashes only decide how many rare values
    reach the second count.  ``buckets`` follow from ``share``; shares so small that
    ``MOST_BUCKETS`` would not tell values apart are refused.  An empty table has no rows.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    if buckets is None:
        if 2 / share > MOST_BUCKETS:
            raise ValueError(f"share must be at least {2 / MOST_BUCKETS:.1e}")
        buckets = min(MOST_BUCKETS, max(BUCKETS, 1 << math.ceil(math.log2(8 / share))))
    keyed = rows.select(key.alias("value")).where("length(value) > 0")
    bucket = [F.pmod(F.xxhash64(F.lit(i), F.col("value")), F.lit(buckets)).cast("int") for i in range(hashes)]
    pairs = F.array(*[F.struct(F.lit(i).alias("hash"), bucket[i].alias("bucket")) for i in range(hashes)])
    counts = materialise(keyed.select(F.inline(pairs)).groupBy("hash", "bucket").agg(F.count("*").alias("n")), "buckets")
    total = counts.where("hash = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = share * total
    over = counts.where(F.col("n") >= F.lit(least)).collect() if total else []  # at most 1 / share for each hash
    heavy = [[r.bucket for r in over if r.hash == i] for i in range(hashes)]
    if not all(heavy):
        return keyed.where("false").select("value", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("share"))
    survivors = keyed.where(reduce(lambda a, b: a & b, [bucket[i].isin(heavy[i]) for i in range(hashes)]))
    counted = survivors.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(least))
    return counted.select("value", "n", (F.col("n") / F.lit(float(total))).alias("share"))
