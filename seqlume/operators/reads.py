"""Measures of whole reads: length, GC content, mean score, and their summaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlume.functions.columns import ERROR_UNIT, ERRORS, bases_of, gc_bucket, norm
from seqlume.operators.profile import usable_scores
from seqlume.plans.arrow import text_bytes
from seqlume.plans.bins import bin_index, bins_for, label

LIMITS = [5, 7, 10, 12, 15, 20, 30]
PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]

_ERROR = np.zeros(256, np.int64)
_ERROR[33 : 33 + len(ERRORS)] = ERRORS


_LIMIT = np.array(ERRORS, np.int64)
#: 10^12 * length stays below 2^63 up to this many bases; longer reads are summed as Python numbers.
_EXACT = 9_000_000


def _mean_score(total: int, length: int) -> int:
    return max([q for q, e in enumerate(ERRORS) if total <= length * e], default=0)


@F.arrow_udf(T.StructType([T.StructField("error", T.DoubleType()), T.StructField("phred", T.IntegerType()), T.StructField("q20", T.LongType())]))
def scores(qualities: pa.Array) -> pa.Array:
    """Summed error probability, mean score rounded down, and bases of score 20 or more.

    Sums are exact, in units of 10^-12, so they do not depend on the order of
    bases.  The mean score is the largest q with sum <= length * error(q); null
    for no bases.
    """
    data, offsets = text_bytes(qualities)
    lengths = np.diff(offsets)
    some = lengths > 0
    totals, good = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if some.any():
        starts = offsets[:-1][some]
        totals[some] = np.add.reduceat(_ERROR[data], starts)
        good[some] = np.add.reduceat((data >= 53).astype(np.int64), starts)
    safe = np.where(lengths > _EXACT, 0, lengths)
    mean = np.where(some, totals, 1) / np.maximum(lengths, 1)
    score = np.clip(np.searchsorted(-_LIMIT, -mean, "right") - 1, 0, len(ERRORS) - 1)
    # The quotient is rounded; whole numbers decide between neighbours.
    over = np.minimum(score + 1, len(ERRORS) - 1)
    score = np.where(totals <= safe * _LIMIT[over], over, score)
    score = np.where((totals > safe * _LIMIT[score]) & (score > 0), score - 1, score)
    error = totals / ERROR_UNIT
    for i in np.flatnonzero(lengths > _EXACT):
        counts = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)[33 : 33 + len(ERRORS)].tolist()
        total = sum(n * e for n, e in zip(counts, ERRORS, strict=True))
        score[i], error[i] = _mean_score(total, int(lengths[i])), total / ERROR_UNIT
    phred = pa.array(score.astype(np.int32), mask=~some)
    return pa.StructArray.from_arrays([pa.array(error), phred, pa.array(good)], names=["error", "phred", "q20"])


_RATES = np.zeros(256)
_RATES[33 : 33 + len(ERRORS)] = [10 ** (-q / 10) for q in range(len(ERRORS))]


@F.arrow_udf(T.IntegerType())
def lane_phred(qualities: pa.Array) -> pa.Array:
    """Mean score rounded down from a sum of doubles in four lanes, for parity.

    Every fourth score is added up by itself for the first 4 * ((n - 1) div 4)
    scores; the lanes are added in order, then the scores that are left.  In that order reads
    of equal scores can come out one lower.
    """
    data, offsets = text_bytes(qualities)
    lengths = np.diff(offsets)
    found, some = np.zeros(len(lengths), np.int32), lengths > 0
    for size in np.unique(lengths[some]).tolist():  # reads of one length are one matrix
        whole = (size - 1) // 4 * 4
        same = np.flatnonzero(lengths == size)
        for part in np.array_split(same, -(-len(same) * size // 4_000_000)):
            rates = _RATES[data[offsets[part][:, None] + np.arange(size)]]
            total = np.zeros(len(part))
            if whole:
                lanes = np.cumsum(rates[:, :whole].reshape(len(part), -1, 4), axis=1)[:, -1]
                for lane in range(4):
                    total += lanes[:, lane]
            for place in range(whole, size):
                total += rates[:, place]
            found[part] = [math.floor(-10.0 * math.log10(mean)) for mean in (total / size).tolist()]
    return pa.array(found, pa.int32(), mask=~some)


def facts(reads: DataFrame, by: list[str], parity: bool = False) -> DataFrame:
    """A row for each read: ``by``, ``length``, ``gc``, ``acgt``, ``gc_bucket``, ``phred`` and ``q20``.

    Null sequences are reads of length 0, and scores that cannot be used count
    as missing.  ``parity`` takes mean scores from ``lane_phred``.
    """
    normal = F.coalesce(norm(F.col("sequence")), F.lit(""))
    usable = usable_scores(F.col("sequence"), F.col("qualities"))
    base = reads.select(*by, normal.alias("normal"), scores(usable).alias("s"), *([lane_phred(usable).alias("lanes")] if parity else []))
    s = F.col("normal")
    return base.select(
        *by, F.length(s).alias("length"), bases_of(s, "CG").alias("gc"), bases_of(s, "ACGT").alias("acgt"), gc_bucket(s).alias("gc_bucket"),
        F.col("lanes" if parity else "s.phred").alias("phred"), F.coalesce("s.q20", F.lit(0)).alias("q20"),
    )


def summary(facts: DataFrame, by: list[str]) -> DataFrame:
    """Reads, bases and lengths.  ``minimum_length`` is 0 without reads."""
    reads = F.count("*")
    total = F.coalesce(F.sum("length"), F.lit(0)).cast("long")
    return facts.groupBy(*by).agg(
        F.round(total / F.greatest(reads, F.lit(1)), 6).alias("mean_length"),
        F.coalesce(F.min("length"), F.lit(0)).cast("long").alias("minimum_length"),
        F.coalesce(F.max("length"), F.lit(0)).cast("long").alias("maximum_length"),
        reads.alias("total_reads"),
        F.count_if(F.col("phred") >= 20).alias("q20_reads"),
        total.alias("total_bases"),
        F.coalesce(F.sum("q20"), F.lit(0)).cast("long").alias("q20_bases"),
        F.coalesce(F.sum("gc"), F.lit(0)).cast("long").alias("total_gc_bases"),
        F.coalesce(F.sum(F.col("length") - F.col("acgt")), F.lit(0)).cast("long").alias("total_n_bases"),
    )


def _histogram(facts: DataFrame, by: list[str], value: Column, name: str, top: int) -> DataFrame:
    """Counts of every value 0 to ``top``, those that do not occur included."""
    # Counting what is not null keeps the test above the aggregate: as a filter of the key it would move
    # into the scan and work the value out again for each of its terms.
    counted = facts.groupBy(*by, value.cast("int").alias(name)).agg(F.count(value).alias("n")).where("n > 0")
    groups = facts.select(*by).distinct() if by else facts.sparkSession.range(1).select()
    frame = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(top))).alias(name))
    on = [frame[c].eqNullSafe(counted[c]) for c in [*by, name]]
    return frame.join(counted, on, "left").select(*[frame[c] for c in [*by, name]], F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gc_histogram(facts: DataFrame, by: list[str]) -> DataFrame:
    """Reads by GC percentage, 0 to 100."""
    return _histogram(facts, by, F.col("gc_bucket"), "gc", 100)


def gc_smooth(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring percentages two by two, 100 on its own."""
    return histogram.groupBy(*by, F.floor(F.col("gc") / 2).cast("int").alias("slot")).agg(F.sum("n").alias("n"))


def phred_histogram(facts: DataFrame, by: list[str]) -> DataFrame:
    """Reads by mean score, 0 to 93."""
    return _histogram(facts, by, F.col("phred"), "phred", 93)


def above_limits(facts: DataFrame, by: list[str]) -> DataFrame:
    """Reads whose mean score reaches a limit, and their share of reads with a score."""
    counts = facts.groupBy(*by).agg(F.count("phred").alias("total"), *[F.count_if(F.col("phred") >= q).alias(f"n{q}") for q in LIMITS])
    rows = F.array(*[F.struct(F.lit(q).alias("limit"), F.col(f"n{q}").alias("n")) for q in LIMITS])
    return counts.select(*by, "total", F.inline(rows)).select(*by, "limit", "n", F.round(F.col("n") / F.greatest(F.col("total"), F.lit(1)), 6).alias("fraction"))


def lengths(facts: DataFrame, by: list[str]) -> DataFrame:
    """How many reads have each length."""
    return facts.groupBy(*by, "length").agg(F.count("*").alias("n"))


def length_distribution(counts: DataFrame, by: list[str], longest: int | None = None) -> DataFrame:
    """Reads by length bin; empty reads have a bin of their own, "0", which is the first."""
    if longest is None:
        longest = counts.agg(F.max("length")).first()[0] or 0
    bins = bins_for(longest) if longest else [(0, 1)]
    place = F.when(F.col("length") == 0, 0).otherwise(bin_index(F.col("length") - 1, [b for _, b in bins]) + 1)
    names = F.array(*[F.lit(x) for x in ["0", *[label(a, b) for a, b in bins]]])
    return counts.groupBy(*by, place.alias("slot")).agg(F.sum("n").alias("n")).select(*by, "slot", names[F.col("slot")].alias("label"), "n")


def length_percentiles(counts: DataFrame, by: list[str]) -> DataFrame:
    """The length of the read at rank floor(p * reads / 100) in order of length."""
    order = Window.partitionBy(*by).orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    found = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * F.col("total") / 100), F.col("length"))).cast("long").alias(f"q{p}") for p in PERCENTILES]
    return running.groupBy(*by).agg(*found)


def n50_n90(counts: DataFrame, by: list[str]) -> DataFrame:
    """Shortest length up to which reads hold half (a tenth for N90) of all bases; 0 if that is none."""
    bases = F.col("length").cast("long") * F.col("n")
    order = Window.partitionBy(*by).orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("upto", F.sum(bases).over(order)).withColumn("total", F.sum(bases).over(Window.partitionBy(*by)))

    def first(threshold: Column) -> Column:
        return F.coalesce(F.min(F.when((threshold > 0) & (F.col("upto") >= threshold), F.col("length"))), F.lit(0)).cast("long")

    return running.groupBy(*by).agg(first(F.floor(F.col("total") / 2)).alias("n50"), first((F.col("total") * F.lit(0.1)).cast("long")).alias("n90"))
