"""How much of a run is duplicates, from fingerprints of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.functions.hashes import murmur3_64
from seqlume.operators.reads import scores
from seqlume.plans.scratch import materialise

MOST_STORED = 1_000_000
#: The buckets of the duplication report, by their last count.
BUCKETS = [1, 2, 3, 4, 5, 10, 20, 30, 50, 100, 500, 1000, 5000, 10000, 50000]
BUCKET_LABELS = ["1", "2", "3", "4", "5", "6-10", "11-20", "21-30", "31-50", "51-100", "101-500", "501-1000", "1001-5000", "5001-10000", "10001-50000", "> 50000"]


def fingerprint_counts(reads: DataFrame, print_: Column, by: list[str]) -> DataFrame:
    """``bases``, ``length_class`` and ``n`` for each fingerprint; rows without bases are left out."""
    return reads.select(*by, print_.alias("f")).where("f.bases is not null").groupBy(*by, "f.bases", "f.length_class").agg(F.count("*").alias("n"))


def subsampled(counts: DataFrame, most: int = MOST_STORED, parity: bool = False) -> tuple[DataFrame, int]:
    """Fingerprints whose hash ends in b zero bits, for the smallest b that keeps ``most`` or fewer; and b.

    How many hashes end in how many zeros is one small table, so b is found
    without trying.  The hash is xxhash64, or with ``parity`` MurmurHash3 seeded
    with the length class.
    """
    if most < 100:
        raise ValueError("most must be at least 100")
    hashed = counts.withColumn("_h", murmur3_64("bases", F.col("length_class").cast("long")) if parity else F.xxhash64("bases", "length_class"))
    zeros = F.when(F.col("_h") == 0, 64).otherwise(F.bit_count((F.col("_h") - 1).bitwiseAND(F.bitwise_not("_h"))))
    hashed = materialise(hashed.withColumn("_zeros", zeros), "fingerprints")
    rows = {r["_zeros"]: r["count"] for r in hashed.groupBy("_zeros").count().collect()}  # 65 rows at most
    bits = next(b for b in range(65) if sum(n for z, n in rows.items() if z >= b) <= most or b == 64)
    return hashed.where(F.col("_zeros") >= bits).drop("_h", "_zeros"), bits


def duplication_histogram(counts: DataFrame, by: list[str]) -> DataFrame:
    """How many fingerprints occur ``times`` times."""
    return counts.groupBy(*by, F.col("n").alias("times")).agg(F.count("*").alias("fingerprints"))


def remaining_fraction(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Distinct fingerprints, reads, and the share of reads that is left without duplicates."""
    reads = F.sum(F.col("times") * F.col("fingerprints"))
    return histogram.groupBy(*by).agg(F.sum("fingerprints").alias("unique"), reads.alias("reads"), F.round(F.sum("fingerprints") / reads, 6).alias("remaining"))


def duplication_buckets(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Share of reads by how often their fingerprint occurs; buckets without reads are 0."""
    place = F.lit(len(BUCKETS))
    for i in reversed(range(len(BUCKETS))):
        place = F.when(F.col("times") <= BUCKETS[i], i).otherwise(place)
    reads = F.col("times") * F.col("fingerprints")
    sums = [F.sum(F.when(place == i, reads).otherwise(0)).alias(f"b{i}") for i in range(len(BUCKET_LABELS))]
    wide = histogram.groupBy(*by).agg(F.sum(reads).alias("total"), *sums)
    rows = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(name).alias("bucket"), F.col(f"b{i}").alias("reads")) for i, name in enumerate(BUCKET_LABELS)])
    return wide.select(*by, "total", F.inline(rows)).select(*by, "slot", "bucket", "reads", F.round(F.col("reads") / F.col("total"), 6).alias("fraction"))


def fingerprint_errors(reads: DataFrame, qualities_print: Column, by: list[str]) -> DataFrame:
    """Reads by the errors expected in their fingerprint, rounded half to even.

    ``qualities_print`` is the fingerprint expression over qualities; reads
    without usable qualities are left out.
    """
    expected = reads.select(*by, scores(qualities_print["bases"])["error"].alias("e"), qualities_print["bases"].alias("q")).where("q is not null")
    return expected.groupBy(*by, F.bround("e").cast("int").alias("errors")).agg(F.count("*").alias("n"))
