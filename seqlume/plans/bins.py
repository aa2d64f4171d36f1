"""Position bins: how positions of reads are brought together for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reads up to this length get bins of equal width, longer ones of growing width.
LINEAR_UP_TO = 500
LINEAR_BINS = 200
#: 400 growing bins reach the longest human chromosome.
GROWTH = 250_000_000 ** (1 / 400)
LEAST_WIDTH = 5


def linear(length: int, parts: int = LINEAR_BINS) -> list[tuple[int, int]]:
    """``parts`` half-open ranges over ``length``; the wider ones come last, empty ones are left out."""
    width, wider = divmod(length, parts)
    edges = [i * width + max(0, i - (parts - wider)) for i in range(parts + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def growing(length: int, least: int = LEAST_WIDTH) -> list[tuple[int, int]]:
    """Ranges whose ends grow by a constant factor but are ``least`` apart at least."""
    found, start, i = [], 0, 0
    while not found or start < length:
        stop = round(GROWTH**i)
        i += 1
        if stop >= start + least:
            found.append((start, stop))
            start = stop
    return found


def bins_for(longest: int) -> list[tuple[int, int]]:
    return linear(longest) if longest <= LINEAR_UP_TO else growing(longest)


def label(start: int, stop: int) -> str:
    """Positions as people count them."""
    return str(stop) if stop == start + 1 else f"{start + 1}-{stop}"


def bins_table(spark: SparkSession, longest: int) -> DataFrame:
    """``bin``, ``start``, ``stop``, ``label``; a few hundred rows at most."""
    rows = [(i, a, b, label(a, b)) for i, (a, b) in enumerate(bins_for(longest))]
    return spark.createDataFrame(rows, "bin int, start int, stop int, label string")


def bin_of(pos: Column, bins: DataFrame) -> Column:
    """The bin a position is in, as an expression over an array of the bins' ends.

    A search in a literal array needs no range join and no shuffle.
    """
    stops = [r.stop for r in bins.orderBy("bin").select("stop").collect()]  # a few hundred
    if not stops:
        return F.lit(None).cast("int")
    return bin_index(pos, stops)


def bin_index(pos: Column, stops: list[int]) -> Column:
    """Index of the first stop greater than ``pos``, by halving."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(pos < stops[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(stops) - 1)
