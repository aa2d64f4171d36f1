"""Fragments that more reads have than chance allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlume.functions.columns import fragments, norm

K, SAMPLE_EVERY, FROM_START, FROM_END, MOST_UNIQUE = 21, 8, 100, 100, 5_000_000
#: Read numbers of a range; reads are put in order within ranges only.
RANGE = 65_536


def sampled(reads: DataFrame, every: int = SAMPLE_EVERY, order_col: str = "read_idx", by: list[str] | None = None) -> DataFrame:
    """Each ``every``-th read in order of arrival, by its number; not a random sample.

    A table of one file is sampled by the numbers themselves.  Where it holds
    several, ``by`` tells them apart and each is sampled by the places its reads
    have in it, as if it were read alone.  Numbers are unique within a file;
    reads without one are left out.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    if not by:
        return reads.where(F.col(order_col) % every == 0)
    ranged = reads.where(F.col(order_col).isNotNull()).withColumn("_range", F.floor(F.col(order_col) / RANGE))
    # One row for each range of numbers, so the running sum is over a small table.
    before = F.sum("_rows").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_rows")
    offsets = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_rows")).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_of"), before.alias("_before"))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order_col)) - 1)
    on = [F.col("_range") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]]
    return placed.join(offsets, on).where((F.col("_before") + F.col("_place")) % every == 0).select(*reads.columns)


def fragment_lists(reads: DataFrame, by: list[str], k: int = K, from_start: int = FROM_START, from_end: int = FROM_END) -> DataFrame:
    """``by`` and the fragments of each read."""
    if k % 2 == 0 or not 3 <= k <= 31:
        raise ValueError("k must be odd and between 3 and 31")
    normal = reads.select(*by, F.coalesce(norm(F.col("sequence")), F.lit("")).alias("s"))
    return normal.select(*by, fragments(F.col("s"), k, from_start, from_end).alias("fragments"))


def fragment_counts(lists: DataFrame, by: list[str]) -> DataFrame:
    """``fragment`` and ``n``, the number of reads that have it."""
    return lists.select(*by, F.explode(F.array_distinct("fragments")).alias("fragment")).groupBy(*by, "fragment").agg(F.count("*").alias("n"))


def first_come(reads: DataFrame, most: int = MOST_UNIQUE, k: int = K, from_start: int = FROM_START, from_end: int = FROM_END, order_col: str = "read_idx", by: list[str] | None = None) -> DataFrame:
    """``fragment_counts`` of the ``most`` fragments that occur first, for parity with bounded stores; with ``by`` one store each."""
    by = by or []
    normal = reads.select(*by, order_col, F.coalesce(norm(F.col("sequence")), F.lit("")).alias("s"))
    placed = normal.select(*by, order_col, F.posexplode(F.array_distinct(fragments(F.col("s"), k, from_start, from_end))).alias("place", "fragment"))
    counted = placed.groupBy(*by, "fragment").agg(F.count("*").alias("n"), F.min(F.struct(order_col, "place")).alias("first"))
    if by:
        return counted.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("first"))).where(F.col("_n") <= most).select(*by, "fragment", "n")
    return counted.orderBy("first").limit(most).select("fragment", "n")


def fragment_totals(lists: DataFrame, by: list[str]) -> DataFrame:
    """``sampled`` reads and ``total_fragments``, repeats within a read included."""
    return lists.groupBy(*by).agg(F.count("*").alias("sampled"), F.coalesce(F.sum(F.size("fragments")), F.lit(0)).cast("long").alias("total_fragments"))


def overrepresented(counts: DataFrame, totals: DataFrame, by: list[str], fraction: float = 0.001, least: int = 100, most: int = (1 << 63) - 1) -> DataFrame:
    """Fragments in at least ceil(fraction * sampled) reads, that bound kept within ``least`` and ``most``.

    ``fragment``, ``n`` and ``fraction`` of the sampled reads.
    """
    if not 0 <= fraction <= 1 or least < 1 or most < 1:
        raise ValueError("fraction must be within 0 and 1, least and most at least 1")
    bound = F.least(F.lit(most), F.greatest(F.lit(min(least, most)), F.ceil(F.col("sampled") * F.lit(fraction))))
    t = totals.select(*by, "sampled", bound.alias("bound"))
    joined = counts.join(F.broadcast(t), by) if by else counts.crossJoin(F.broadcast(t))  # one row for each file
    return joined.where("n >= bound").select(*by, "fragment", "n", F.round(F.col("n") / F.col("sampled"), 6).alias("fraction"))
