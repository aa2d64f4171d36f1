"""Percentiles of very large columns by merging centroid digests.

Sorted values are clustered so that a cluster spans about one step of
k(q) = d / (2 pi) * asin(2q - 1): clusters are small where q is near 0 or 1.
Digests merge by sorting all centroids and clustering again.  A second pass
counts the values below and at each estimate, which certifies its rank error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.llm.grouped import merge_summaries, summarise
from seqlume.plans.skew import lookup

#: Twice the largest number of centroids of a digest.
SIZE = 500
#: Levels of merging a digest goes through: a batch, a worker, a salt, a group.  Stored parts add one.
LEVELS = 4
#: Items: a centroid, its weight, and whether it stands for different values (1) or one (0).
FIELDS = {"means": "double", "weights": "double", "mixed": "int"}


def rank_error(q: float, size: int = SIZE, levels: int = LEVELS) -> float:
    """Stated bound on the rank error at ``q``, as a share of all values.

    Clustering single values, a cluster spans at most one step of k.  What is
    merged is counted by its middle, so half of the first and half of the last
    part may lie outside: each level of merging adds a step at most.  An estimate
    lies within one cluster's width.
    """
    return levels * 2 * math.pi / size * math.sqrt(q * (1 - q))


def merge(group: np.ndarray, items: dict[str, np.ndarray], size: int = SIZE) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Cluster the centroids of every group anew."""
    if not len(group):
        return group, items
    order = np.lexsort((items["means"], group))
    group, mean, weight = group[order], items["means"][order], items["weights"][order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    counts = np.diff(np.append(first, len(group)))
    total = np.repeat(np.add.reduceat(weight, first), counts)
    before = np.cumsum(weight) - weight
    before -= np.repeat(before[first], counts)
    middle = np.clip((before + weight / 2) / total, 0, 1)
    step = np.floor(size / (2 * math.pi) * np.arcsin(2 * middle - 1))
    mixed = items["mixed"][order]
    # Equal values that fill several steps stay several centroids, whose middles agree.
    joined = (group[1:] == group[:-1]) & (step[1:] == step[:-1])
    start = np.flatnonzero(np.concatenate([[True], ~joined]))
    weights = np.add.reduceat(weight, start)
    low = mean[start]
    means = low + np.add.reduceat((mean - np.repeat(low, np.diff(np.append(start, len(mean))))) * weight, start) / weights
    mixed = np.maximum(np.maximum.reduceat(mixed, start), np.maximum.reduceat(mean, start) != low).astype(np.int32)
    return group[start], {"means": means, "weights": weights, "mixed": mixed}


def quantile(means: np.ndarray, weights: np.ndarray, mixed: np.ndarray, q: float, reach: bool = False) -> float:
    """The value at rank ``q``: that of the centroid there if it stands for one
    value, else interpolated between the middles of centroids.

    The rank is that of the first value up to which more than a share ``q`` lies
    or, with ``reach``, floor(q * total) at least, as N50 has it.
    """
    ends = np.cumsum(weights)
    target = math.floor(q * ends[-1]) if reach else q * ends[-1]
    at = min(int(np.searchsorted(ends, target, "left" if reach else "right")), len(ends) - 1)
    if not mixed[at]:
        return float(means[at])
    return float(np.interp(target, ends - weights / 2, means))


def digests(rows: DataFrame, value: Column, keys: list[str], sets: list[list[str]], weight: Column | None = None) -> DataFrame:
    """Mergeable digests of ``value`` for each group; nulls, NaN and weights of 0 are left out.

    Null keys are a group like others, repeated rows count each, and a group
    without values, so also an empty table, has no row.
    """
    chosen = rows.select(*keys, value.cast("double").alias("_value"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_weight"))
    chosen = chosen.where("_value is not null and not isnan(_value) and _weight > 0")

    def lift(values: pa.Array, weights: pa.Array) -> dict[str, np.ndarray]:
        return {"means": values.to_numpy(zero_copy_only=False), "weights": weights.to_numpy(zero_copy_only=False), "mixed": np.zeros(len(values), np.int32)}

    return summarise(chosen, keys, sets, ["_value", "_weight"], FIELDS, lift, merge)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Digests of unions: of stored parts or days that share ``keys``."""
    return merge_summaries(parts, keys, FIELDS, merge)


def percentiles(parts: DataFrame, wanted: dict[str, float], whole: bool = False, reach: bool = False) -> DataFrame:
    """``parts`` with a column for each wanted quantile and ``total`` weight.

    ``whole`` rounds, for columns of whole numbers; ``reach`` is that of ``quantile``.
    """
    names = list(wanted)

    @F.pandas_udf(", ".join(f"{n} double" for n in [*names, "total"]))
    def evaluate(means, weights, mixed):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = []
        for m, w, x in zip(means, weights, mixed, strict=True):
            found = [quantile(m, w, x, q, reach) for q in wanted.values()]
            rows.append([float(round(v)) if whole else v for v in found] + [float(np.sum(w))])
        return pd.DataFrame(rows, columns=[*names, "total"])

    return parts.withColumn("_q", evaluate("means", "weights", "mixed")).select("*", "_q.*").drop("_q", *FIELDS)


def certified(estimates: DataFrame, rows: DataFrame, value: Column, keys: list[str], sets: list[list[str]], wanted: dict[str, float], weight: Column | None = None, reach: bool = False) -> DataFrame:
    """``estimates`` with ``<name>_rank_error``: the measured rank error of each estimate.

    The estimates are brought to the rows, and how much lies below and at each is
    summed before anything shuffles; where the estimates are too many to broadcast the
    rows of a large group are spread.  The target rank is floor(q * total); the error is
    0 if a value of that rank equals the estimate, else its distance in ranks as a
    share of the total.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    base = rows.select(*keys, value.cast("double").alias("_value"), w.alias("_w")).where("_value is not null and not isnan(_value) and _w > 0")
    choice = F.array(*[F.struct(F.lit(",".join(s)).alias("grouping"), *[(F.col(k) if k in s else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in keys]) for s in sets])
    spread = base.select(F.explode(choice).alias("_g"), "_value", "_w").select("_g.*", "_value", "_w")
    # Groups are found by 128 bits of hash, for nulls are values here; the rows of a large group are spread.
    group = [F.xxhash64("grouping", *keys).alias("_k1"), F.xxhash64(F.lit(5), "grouping", *keys).alias("_k2")]
    e = estimates.select(*group, *wanted, F.col("total").alias("_rows"))
    joined = lookup(spread.select("*", *group), e, ["_k1", "_k2"], weight="_rows")
    sums = [F.sum("_w").alias("_total")]
    for n in wanted:
        sums.append(F.sum(F.when(F.col("_value") < F.col(n), F.col("_w")).otherwise(0.0)).alias(f"_lt_{n}"))
        sums.append(F.sum(F.when(F.col("_value") <= F.col(n), F.col("_w")).otherwise(0.0)).alias(f"_le_{n}"))
    counted = joined.groupBy("grouping", *keys, *wanted).agg(*sums)
    errors = []
    for n, q in wanted.items():
        target = F.floor(F.col("_total") * q)
        after = 1 if reach else 0  # with ``reach`` a value's ranks are (below, up to it], else [below, up to it)
        far = F.greatest(F.lit(0.0), F.col(f"_lt_{n}") + after - target, target + 1 - after - F.col(f"_le_{n}"))
        errors.append((far / F.col("_total")).alias(f"{n}_rank_error"))
    return counted.select("grouping", *keys, *wanted, F.col("_total").alias("total"), *errors)
