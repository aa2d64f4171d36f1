"""Queries over the test tables for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlume.llm import digest, distinct, encode, frequent, leaks, lookalike, seen, spans
from seqlume.plans.scratch import materialise
from seqlume.tables import load

_ADAPTERS_FROM = -(1 << 62)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Long reads and adapters; adapters get numbers far below those of reads."""
    reads = load(spark, sf, "long_reads").select(F.col("read_idx").alias("record"), "sequence")
    adapters = load(spark, sf, "adapters").select((F.lit(_ADAPTERS_FROM) + F.col("adapter_id")).alias("record"), "sequence")
    return reads.unionByName(adapters)


def _is_read(col: str) -> Column:
    return F.col(col) > _ADAPTERS_FROM // 2


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal runs of bases that windows of 40 share with another record."""
    runs = spans.shared_runs(spans.chains(spans.matches(_records(spark, sf))))
    return runs.where(_is_read("record")).select(F.col("record").alias("read_idx"), F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def p1_shared(spark: SparkSession, sf: str) -> DataFrame:
    """For every long read how many of its bases are shared elsewhere."""
    reads = load(spark, sf, "long_reads").where("read_idx is not null").groupBy("read_idx").agg(F.max(F.length("sequence")).alias("length"))
    shared = p1_found(spark, sf).groupBy("read_idx").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"), F.count("*").alias("spans"))
    n = F.coalesce(F.col("length"), F.lit(0)).cast("long")
    bases = F.coalesce(F.col("shared"), F.lit(0)).cast("long")
    return reads.join(shared, "read_idx", "left").select(
        "read_idx", n.alias("length"), bases.alias("shared_bases"), F.coalesce("spans", F.lit(0)).cast("long").alias("spans"), F.when(n > 0, F.round(bases / n, 6)).otherwise(0.0).alias("shared_fraction")
    )


def p1_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Fuzzy passages: aligned chains of a read and another record, between all different texts."""
    return spans.fuzzy_passages(_records(spark, sf)).where(_is_read("record")).withColumnRenamed("record", "read_idx")


def _spellings(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def _distinct_sets(spark: SparkSession, sf: str) -> tuple[list[str], list[list[str]], DataFrame]:
    """Day, run, sample and mate, all combinations of them, and the sequences to count."""
    reads = load(spark, sf, "short_reads").select(F.to_date("seen_at").alias("day"), "run_id", "sample", "mate", F.upper("sequence").alias("value"))
    keys = ["day", "run_id", "sample", "mate"]
    return keys, [list(c) for n in range(len(keys) + 1) for c in combinations(keys, n)], reads


def p2_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct sequences for each combination of day, run, sample and mate, beside the reported reads."""
    keys, sets, reads = _distinct_sets(spark, sf)
    counted = distinct.estimate(distinct.sketches(reads, F.col("value"), keys, sets)).drop(*distinct.FIELDS)
    last = Window.partitionBy("run_id", "sample", "mate").orderBy(F.desc("created_at"), F.desc("report_id"))
    reports = load(spark, sf, "summary").where(_spellings("technology") == "illumina").where("total_reads is not null")
    reports = reports.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("run_id", "sample", "mate", "total_reads")
    # Reports are not by day: they stand beside the combinations without it.
    dayless = [s for s in sets if "day" not in s]
    choice = F.array(*[F.struct(F.lit(",".join(s)).alias("grouping"), *[(F.col(k) if k in s else F.lit(None).cast(reports.schema[k].dataType)).alias(k) for k in keys[1:]]) for s in dayless])
    reported = reports.select(F.explode(choice).alias("g"), "total_reads").groupBy("g").agg(F.sum("total_reads").alias("total_reads")).select("g.*", "total_reads")
    on = [counted[k].eqNullSafe(reported[k]) for k in ["grouping", *keys[1:]]]
    return counted.join(reported, on, "left").select(*[counted[k] for k in ["grouping", *keys]], "distinct", "error", "total_reads")


def p2_within(spark: SparkSession, sf: str) -> DataFrame:
    """For each group of p2_distinct whether its estimate is within five standard errors of the exact count (or 2.5 for small groups)."""
    keys, sets, reads = _distinct_sets(spark, sf)
    estimated = distinct.estimate(distinct.sketches(reads, F.col("value"), keys, sets)).drop(*distinct.FIELDS)

    def name(grouping: Column, chosen: list[str]) -> Column:
        """A hash of a group, nulls told apart; columns that a set has not are null."""
        return F.xxhash64(grouping, *[F.coalesce((F.col(k) if k in chosen else F.lit(None)).cast("string"), F.lit("\0")) for k in keys])

    # Exact to 64 bits of hash: what shuffles is two numbers for each set a row is in, copies of a task left out.
    names = F.array(*[name(F.lit(",".join(s)), s) for s in sets])
    exact = reads.where("value is not null").select(F.explode(names).alias("g"), F.xxhash64("value").alias("h")).distinct().groupBy("g").agg(F.count("*").alias("exact"))
    close = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(2.5), 5 * F.col("error") * F.col("exact"))
    return exact.join(estimated.withColumn("g", name(F.col("grouping"), keys)), "g", "left").select("grouping", *keys, F.coalesce(close, F.lit(False)).alias("within"))


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Read lengths; null and empty sequences are reads of length 0, a long read counts once."""
    short = load(spark, sf, "short_reads").select(F.lit("illumina").alias("technology"), "run_id", "sample", F.to_date("seen_at").alias("day"), F.coalesce(F.length("sequence"), F.lit(0)).alias("length"))
    once = load(spark, sf, "long_reads").groupBy("read_idx").agg(F.min(F.struct("run_id", "sample", "start_time", F.coalesce(F.length("sequence"), F.lit(0)).alias("length"))).alias("r"))
    long = once.select(F.lit("nanopore").alias("technology"), "r.run_id", "r.sample", F.to_date("r.start_time").alias("day"), "r.length")
    return short.unionByName(long)


def _percentiles(rows: DataFrame, keys: list[str], sets: list[list[str]], wanted: dict[str, float], weight: Column | None = None, reach: bool = False) -> DataFrame:
    found = digest.percentiles(digest.digests(rows, F.col("value"), keys, sets, weight), wanted, whole=True, reach=reach)
    return digest.certified(materialise(found, "percentiles"), rows, F.col("value"), keys, sets, wanted, weight, reach)


def p4_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Median, N50 and 99th percentile of read lengths, with stated and measured rank error."""
    keys = ["technology", "run_id", "sample", "day"]
    # Lengths repeat: the tables are read once, and what follows goes over counts.
    rows = materialise(_lengths(spark, sf).groupBy(*keys, F.col("length").alias("value")).agg(F.count("*").alias("n")), "lengths")
    sets = [[], ["technology"], ["technology", "run_id"], ["technology", "sample"], ["technology", "day"], keys]
    by_read = _percentiles(rows, keys, sets, {"median": 0.5, "p99": 0.99}, F.col("n")).withColumnRenamed("total", "reads")
    by_base = _percentiles(rows, keys, sets, {"n50": 0.5}, F.col("value") * F.col("n"), reach=True).withColumnRenamed("total", "bases")
    on = [by_read[k].eqNullSafe(by_base[k]) for k in ["grouping", *keys]]
    return by_read.join(by_base, on, "left").select(
        *[by_read[k] for k in ["grouping", *keys]], F.col("reads").cast("long").alias("reads"), F.coalesce("bases", F.lit(0.0)).cast("long").alias("bases"),
        "median", F.coalesce("n50", F.lit(0.0)).alias("n50"), "p99", "median_rank_error", F.coalesce("n50_rank_error", F.lit(0.0)).alias("n50_rank_error"), "p99_rank_error",
        F.lit(digest.rank_error(0.5)).alias("stated_error_50"), F.lit(digest.rank_error(0.99)).alias("stated_error_99"),
    )


def p4_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the columns q50, n50 and q99 of the length reports, by technology and day."""
    table = load(spark, sf, "sequence_length_distribution")
    last = Window.partitionBy("run_id", "sample", "mate", "technology").orderBy(F.desc("created_at"), F.desc("report_id"))
    rows = table.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    value = F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("q50", "n50", "q99")]))
    # Negative values are sentinels, not lengths.
    rows = rows.select(_spellings("technology").alias("technology"), F.col("report_date").alias("day"), value).where("value >= 0")
    keys = ["measure", "technology", "day"]
    sets = [["measure"], ["measure", "technology"], keys]
    found = _percentiles(rows, keys, sets, {"p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99})
    return found.withColumn("total", F.col("total").cast("long")).withColumn("stated_error_50", F.lit(digest.rank_error(0.5)))


def p4_within(spark: SparkSession, sf: str) -> DataFrame:
    """For each group of p4_lengths its reads and bases, and whether every measured error is within the stated one."""
    return p4_lengths(spark, sf).select("grouping", "technology", "run_id", "sample", "day", "reads", "bases", (
        (F.col("median_rank_error") <= F.col("stated_error_50")) & (F.col("n50_rank_error") <= F.col("stated_error_50")) & (F.col("p99_rank_error") <= F.col("stated_error_99"))
    ).alias("within"))


def _seen(spark: SparkSession, sf: str) -> seen.Judged:
    upper = F.upper("sequence")
    return seen.judged(load(spark, sf, "short_reads"), upper, "read_idx", load(spark, sf, "prior_sequences"), upper)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose sequence occurred before, in an earlier run or row."""
    return _seen(spark, sf).repeats


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    """The measured errors of the membership filter."""
    return seen.rates(_seen(spark, sf), "read_idx")


def p5_disproved(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the filter took for repeats and the lookup did not."""
    return _seen(spark, sf).disproved


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Keys, repeats and missed repeats, and whether the filter's false positives stay within twice what its size promises."""
    expected = (1 - 2.718281828 ** (-seen.PROBES / seen.BITS_PER_KEY / 1.25)) ** seen.PROBES
    return p5_rates(spark, sf).select("keys", "repeats", "missed", (F.col("false_positive_rate") <= 2 * expected).alias("within"))


def p6_frequent(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences that make up a thousandth of the rows or more, with their counts."""
    return frequent.iceberg(load(spark, sf, "short_reads"), F.upper("sequence"), 0.001).withColumnRenamed("value", "sequence").withColumn("share", F.round("share", 9))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences that make up at least one percent of the rows."""
    return frequent.iceberg(load(spark, sf, "short_reads"), F.upper("sequence"), 0.01).select(F.col("value").alias("sequence"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document's text in byte_bpe_50k."""
    return encode.encode(load(spark, sf, "documents"), encode.default_vocabulary())


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold 12 consecutive words of an evaluation item."""
    return leaks.verbatim(load(spark, sf, "documents"), load(spark, sf, "eval_items"))


def p8_reparameterised(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an item's question with other parameters, under every such item."""
    return leaks.reparameterised(load(spark, sf, "documents"), load(spark, sf, "eval_items"), every=True)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that look the same and differ in their characters."""
    return lookalike.same_look(load(spark, sf, "documents"))


def p9_forms(spark: SparkSession, sf: str) -> DataFrame:
    """For every document a digest of its canonical form and whether that differs from its text."""
    forms = lookalike.canonical(load(spark, sf, "documents"))
    return forms.select("doc_id", F.md5("canonical").alias("form"), F.length("canonical").alias("length"), F.coalesce(F.col("canonical") != F.col("text"), F.lit(False)).alias("changed"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """For every document with something to see the class of texts that look the same."""
    return lookalike.looks_alike(load(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_shared, p1_passages, p2_distinct, p2_within, p4_lengths, p4_within, p4_columns, p5_found, p5_rates, p5_disproved, p5_counts, p6_found, p6_frequent, p7_ids, p8_found, p8_reparameterised, p9_found, p9_forms, p9_classes,
    )}
