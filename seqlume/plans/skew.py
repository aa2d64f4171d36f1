"""Joins that survive a key holding a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is broadcast at most: a row takes some 200 bytes beside its texts, so
#: about 80 MB in memory.
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 32_000_000
#: A key with more rows than this share of the probe side is treated as hot.
HOT_SHARE = 0.002


def _text_size(df: DataFrame) -> Column:
    """Bytes of a row's texts and nested values."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{field.name}`")))), F.lit(0))
    return size


def small(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows and ``size`` bytes of text (counts no further than needed)."""
    found = df.limit(limit + 1).agg(F.count("*").alias("rows"), F.sum(_text_size(df)).alias("bytes")).first()
    return found.rows <= limit and (found.bytes or 0) <= size


def lookup(
    probe: DataFrame,
    unique: DataFrame,
    keys: list[str],
    how: str = "inner",
    weight: str | None = None,
    salts: int = 32,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join many rows with a side that has one row per key.

    A side of checked size is broadcast.  Beyond it both sides shuffle; keys
    whose ``weight`` (rows expected on the probe side, a column of ``unique``)
    exceeds ``HOT_SHARE`` of the total are spread over ``salts`` copies, so no
    task gets a hot key whole.  At most 1 / HOT_SHARE keys can be hot, which
    bounds the list that is broadcast.  Rows that agree in every column stay together.  Without ``weight`` AQE's skew join is
    relied upon.  ``how`` is inner, left or left_semi.  Null keys match nothing.
    """
    if small(unique, broadcast_rows):
        return probe.join(F.broadcast(unique), keys, how)
    if weight is None:
        return probe.join(unique, keys, how)
    total = unique.agg(F.sum(weight).alias("_total"))
    hot = (
        unique.crossJoin(F.broadcast(total))  # one row: the sum
        .where(F.col(weight) > F.col("_total") * HOT_SHARE)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    spread = F.array([F.lit(i) for i in range(salts)])
    right = unique.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), spread).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    # Rows with a null key match nothing; they are spread as well.
    loose = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    # The salt follows from the row, so that a task that runs again sends each row to the same place.
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in probe.columns]), F.lit(salts)).cast("int")
    left = probe.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot") | loose, salt).otherwise(F.lit(0))).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
