"""Queries over the test tables for the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlume import oracles
from seqlume.functions import columns as C
from seqlume.operators import adapters as A
from seqlume.operators import dedup, fragments, identify, nano, pairs, profile, reads, rejects
from seqlume.plans.scratch import scratch_path
from seqlume.sources import sinks, small
from seqlume.sources.bam import read_bam
from seqlume.sources.fastq import read_fastq
from seqlume.tables import load

BY = ["mate"]
RUN = ["run_id", "sample", "mate"]
#: Fragment thresholds: a share of the sampled reads, and a least number of them.
FRACTION, LEAST = 0.001, 5


def _short(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "short_reads")


def _long(spark: SparkSession, sf: str) -> DataFrame:
    """Long reads, each once."""
    return load(spark, sf, "long_reads").dropDuplicates(["read_idx"])


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile(_short(spark, sf), BY)


def _long_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile(_long(spark, sf))


def _facts(spark: SparkSession, sf: str, by: list[str] = BY) -> DataFrame:
    return reads.facts(_short(spark, sf), by)


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of short reads by mate (1, 2) and of long reads (mate 0)."""
    short = _short(spark, sf).select("mate", F.coalesce(F.length("sequence"), F.lit(0)).alias("length"))
    long = _long(spark, sf).select(F.lit(0).alias("mate"), F.coalesce(F.length("sequence"), F.lit(0)).alias("length"))
    return reads.lengths(short.unionByName(long), BY)


def base_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-1: bases by position."""
    return profile.labelled(_profile(spark, sf), "base", BY)


def phred_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-2: score bins by position."""
    return profile.labelled(_profile(spark, sf), "phred", BY)


def end_base_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-3: bases of the last 100 positions, aligned at the end."""
    return profile.labelled(_profile(spark, sf), "end_base", BY)


def end_phred_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-4: score bins of the last 100 positions."""
    return profile.labelled(_profile(spark, sf), "end_phred", BY)


def front_base_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-5: bases of the first 100 positions."""
    return profile.labelled(_profile(spark, sf), "base", BY).where("pos < 100")


def long_base_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-15: bases of long reads by growing bins."""
    return profile.binned(_long_profile(spark, sf), "base", [])


def gc_hist(spark: SparkSession, sf: str) -> DataFrame:
    """A-6: reads by GC percentage."""
    return reads.gc_histogram(_facts(spark, sf), BY)


def gc_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """A-7: GC percentages two by two."""
    return reads.gc_smooth(reads.gc_histogram(_facts(spark, sf), BY), BY)


def mean_phred_hist(spark: SparkSession, sf: str) -> DataFrame:
    """A-8: reads by mean score."""
    return reads.phred_histogram(_facts(spark, sf), BY)


def q_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """A-9: reads that reach a mean score."""
    return reads.above_limits(_facts(spark, sf), BY)


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """A-10, A-11: the summary of each run, sample and mate."""
    return reads.summary(_facts(spark, sf, RUN), RUN)


def summary_cube(spark: SparkSession, sf: str) -> DataFrame:
    """A-11 over all combinations of sample and mate: reads, bases, longest."""
    f = _facts(spark, sf, ["sample", "mate"])
    return f.cube("sample", "mate").agg(F.count("*").alias("total_reads"), F.sum("length").cast("long").alias("total_bases"), F.max("length").alias("maximum_length"), F.grouping_id().cast("long").alias("level"))


def length_dist(spark: SparkSession, sf: str) -> DataFrame:
    """A-12: long reads by length bin."""
    counts = _lengths(spark, sf).where("mate = 0").drop("mate")
    return reads.length_distribution(counts, [])


def length_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """A-13: percentiles of read lengths."""
    return reads.length_percentiles(_lengths(spark, sf), BY)


def n50_n90(spark: SparkSession, sf: str) -> DataFrame:
    """A-14: N50 and N90."""
    return reads.n50_n90(_lengths(spark, sf), BY)


def quality_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """A-16: share of each score bin at each position."""
    return profile.fractions(profile.binned(_profile(spark, sf), "phred", BY), BY)


def end_quality_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """A-16 at the end of reads."""
    end = _profile(spark, sf).where("kind = 'end_phred'").drop("kind")
    return profile.fractions(end, BY, "pos")


def quality_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """A-17: mean score of the worst and best bases at each position."""
    return profile.quality_spread(profile.binned(_profile(spark, sf), "phred", BY), BY)


def long_quality_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """A-17 over growing bins of long reads."""
    return profile.quality_spread(profile.binned(_long_profile(spark, sf), "phred", []), [])


def base_content(spark: SparkSession, sf: str) -> DataFrame:
    """A-18: share of each base at each position."""
    return profile.base_content(profile.binned(_profile(spark, sf), "base", BY), BY)


def n_content(spark: SparkSession, sf: str) -> DataFrame:
    """A-19: share of unknown bases at each position."""
    return profile.n_content(profile.binned(_profile(spark, sf), "base", BY), BY)


def _adapters(spark: SparkSession, sf: str, technology: str) -> list[tuple[str, str, str]]:
    return A.listed(load(spark, sf, "adapters"), technology)


def adapter_hits(spark: SparkSession, sf: str) -> DataFrame:
    """J-3, A-20: reads by adapter and place of its first occurrence."""
    return A.hit_counts(A.hits(_short(spark, sf), _adapters(spark, sf, "illumina"), BY), BY)


def adapter_hits_long(spark: SparkSession, sf: str) -> DataFrame:
    """J-3 for long reads."""
    return A.hit_counts(A.hits(_long(spark, sf), _adapters(spark, sf, "nanopore"), []), [])


def _curve(spark: SparkSession, sf: str, view: str) -> DataFrame:
    short, own = _short(spark, sf), _adapters(spark, sf, "illumina")
    totals = short.groupBy(*BY).agg(F.count("*").alias("reads"))
    longest = short.agg(F.max(F.length("sequence"))).first()[0] or 0
    return A.curve(A.hit_counts(A.hits(short, own, BY), BY), totals, own, BY, longest, view).drop("name")


def adapter_curve(spark: SparkSession, sf: str) -> DataFrame:
    """A-21: share of reads an adapter has reached."""
    return _curve(spark, sf, "all")


def adapter_curve_front(spark: SparkSession, sf: str) -> DataFrame:
    """A-21 over the first 100 positions."""
    return _curve(spark, sf, "front")


def adapter_curve_end(spark: SparkSession, sf: str) -> DataFrame:
    """A-21 over the last 100 positions."""
    return _curve(spark, sf, "end")


def tile_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A-22: summed error and coverage by tile and position."""
    return profile.tile_errors(_short(spark, sf), C.tile(F.col("name")), BY)


def tile_deviation(spark: SparkSession, sf: str) -> DataFrame:
    """A-23: tiles against the mean of tiles."""
    return profile.tile_deviation(tile_errors(spark, sf), BY)


def tile_flags(spark: SparkSession, sf: str) -> DataFrame:
    """A-23: tiles with two or ten times the errors."""
    return profile.flagged_tiles(tile_deviation(spark, sf), BY)


def tile_skip(spark: SparkSession, sf: str) -> DataFrame:
    """P-15: the first header of each mate that has no tile."""
    bad = _short(spark, sf).where(C.tile(F.col("name")).isNull() & F.col("name").isNotNull())
    return bad.groupBy(*BY).agg(F.min_by("name", "read_idx").alias("name"), F.min("read_idx").alias("read_idx"))


def _fragment_lists(spark: SparkSession, sf: str) -> DataFrame:
    return fragments.fragment_lists(fragments.sampled(_short(spark, sf)), BY)


def fragment_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-24: reads by fragment."""
    return fragments.fragment_counts(_fragment_lists(spark, sf), BY)


def fragment_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A-24: sampled reads and all their fragments."""
    return fragments.fragment_totals(_fragment_lists(spark, sf), BY)


def fragment_first_come(spark: SparkSession, sf: str) -> DataFrame:
    """O-7: fragment counts of a store for 5,000 fragments, first come."""
    return fragments.first_come(fragments.sampled(_short(spark, sf)), 5_000)


def overrepresented(spark: SparkSession, sf: str) -> DataFrame:
    """A-25: fragments in more reads than the threshold."""
    lists = _fragment_lists(spark, sf)
    return fragments.overrepresented(fragments.fragment_counts(lists, BY), fragments.fragment_totals(lists, BY), BY, FRACTION, LEAST)


def _mate_fragment_lists(spark: SparkSession, sf: str) -> DataFrame:
    return fragments.fragment_lists(fragments.sampled(_short(spark, sf), by=BY), BY)


def mate_fragment_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-24 with every 8th read of each mate: reads by fragment."""
    return fragments.fragment_counts(_mate_fragment_lists(spark, sf), BY)


def mate_fragment_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A-24 with every 8th read of each mate: sampled reads and all their fragments."""
    return fragments.fragment_totals(_mate_fragment_lists(spark, sf), BY)


def mate_fragment_first_come(spark: SparkSession, sf: str) -> DataFrame:
    """O-7 with every 8th read of each mate: fragment counts of a store of the usual size for each mate, first come."""
    return fragments.first_come(fragments.sampled(_short(spark, sf), by=BY), by=BY)


def mate_overrepresented(spark: SparkSession, sf: str) -> DataFrame:
    """A-25 with every 8th read of each mate: fragments in more reads than the threshold."""
    lists = _mate_fragment_lists(spark, sf)
    return fragments.overrepresented(fragments.fragment_counts(lists, BY), fragments.fragment_totals(lists, BY), BY, FRACTION, LEAST)


def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.fingerprint_counts(_short(spark, sf), C.fingerprint(F.coalesce(F.upper("sequence"), F.lit(""))), BY)


def fingerprint_counts(spark: SparkSession, sf: str) -> DataFrame:
    """P-21, A-26: reads by fingerprint."""
    return _fingerprints(spark, sf)


def pair_fingerprint_counts(spark: SparkSession, sf: str) -> DataFrame:
    """P-22: pairs by fingerprint."""
    paired = _mates(spark, sf).where("problem is null and sequence1 is not null and sequence2 is not null")
    return dedup.fingerprint_counts(paired, C.pair_fingerprint(F.col("sequence1"), F.col("sequence2")), [])


def fingerprint_subsample(spark: SparkSession, sf: str) -> DataFrame:
    """A-26: fingerprints kept by a store of the usual size."""
    kept, bits = dedup.subsampled(_fingerprints(spark, sf))
    return kept.withColumn("bits", F.lit(bits))


def fingerprint_subsample_parity(spark: SparkSession, sf: str) -> DataFrame:
    """A-26 by the public hash of the bases, seeded with the length class."""
    kept, bits = dedup.subsampled(_fingerprints(spark, sf), parity=True)
    return kept.withColumn("bits", F.lit(bits))


def fingerprint_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Reads by the errors to expect in their fingerprint."""
    usable = profile.usable_scores(F.col("sequence"), F.col("qualities"))
    return dedup.fingerprint_errors(_short(spark, sf), C.fingerprint(usable, back_offset=64), BY)


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Whole sequences by how often they occur."""
    whole = F.struct(F.coalesce(F.upper("sequence"), F.lit("")).alias("bases"), F.lit(0).alias("length_class"))
    return dedup.duplication_histogram(dedup.fingerprint_counts(_short(spark, sf), whole, BY), BY)


def mean_phred_parity(spark: SparkSession, sf: str) -> DataFrame:
    """A-8 with sums in four lanes (P-5)."""
    return reads.phred_histogram(reads.facts(_short(spark, sf), BY, parity=True), BY)


def adapter_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Records of earlier runs that hold each adapter, on either strand."""
    prior = load(spark, sf, "prior_sequences").select(C.norm(F.col("sequence")).alias("sequence"))
    own = A.listed(load(spark, sf, "adapters"))
    both = [(n, b, p) for n, b, p in own] + [(n, b[::-1].translate(str.maketrans("ACGT", "TGCA")), p) for n, b, p in own]
    return A.hits(prior, both, []).groupBy("adapter").agg(F.count("*").alias("n"))


def duplication_hist(spark: SparkSession, sf: str) -> DataFrame:
    """A-27: fingerprints by how often they occur."""
    return dedup.duplication_histogram(_fingerprints(spark, sf), BY)


def duplication_remaining(spark: SparkSession, sf: str) -> DataFrame:
    """A-27: what is left without duplicates."""
    return dedup.remaining_fraction(duplication_hist(spark, sf), BY)


def duplication_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """A-28: reads by how often their fingerprint occurs."""
    return dedup.duplication_buckets(duplication_hist(spark, sf), BY)


def _mates(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.mates(_short(spark, sf), ["run_id", "sample"])


def mate_join(spark: SparkSession, sf: str) -> DataFrame:
    """J-1: mates of a template, or which of them is missing."""
    return _mates(spark, sf).select("run_id", "sample", "template", "read_idx1", "read_idx2", "problem")


def mate_zip(spark: SparkSession, sf: str) -> DataFrame:
    """J-1, S-4: rows of either mate zipped by their place in the table, with the problems found."""
    short = _short(spark, sf).withColumn("at", F.col("read_idx")).withColumn("read_idx", F.floor(F.col("read_idx") / 2))
    whole = F.min(F.struct("at", "name", "sequence", "qualities")).alias("r")  # of rows with one place the first, as a whole
    first, second = (short.where(F.col("mate") == m).groupBy("read_idx").agg(whole).select("read_idx", "r.name", "r.sequence", "r.qualities") for m in (1, 2))
    return pairs.zipped(first, second).groupBy("problem").agg(F.count("*").alias("n"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.insert_sizes(_mates(spark, sf).where("sequence1 is not null and sequence2 is not null"), ["run_id"])


def insert_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """J-4, A-29: pairs by insert size."""
    return pairs.insert_histogram(_sized(spark, sf), [])


def overlap_adapters(spark: SparkSession, sf: str) -> DataFrame:
    """A-30: adapters that overlaps reveal."""
    return pairs.overlap_adapters(_sized(spark, sf), [])


def top_adapter_per_length(spark: SparkSession, sf: str) -> DataFrame:
    """A-31: the most frequent adapter of each length."""
    return pairs.top_by_length(overlap_adapters(spark, sf), [])


def _nano(spark: SparkSession, sf: str) -> DataFrame:
    return nano.nano_facts(load(spark, sf, "long_reads"), [])


def nano_slots(spark: SparkSession, sf: str) -> DataFrame:
    """A-32, A-36: a run over time."""
    return nano.time_slots(_nano(spark, sf), [])


def nano_channels(spark: SparkSession, sf: str) -> DataFrame:
    """A-33: bases and mean score by channel."""
    return nano.channels(_nano(spark, sf), [])


def translocation(spark: SparkSession, sf: str) -> DataFrame:
    """A-34: reads by speed."""
    return nano.translocation(_nano(spark, sf), [])


def split_reads(spark: SparkSession, sf: str) -> DataFrame:
    """A-35: reads with a parent."""
    return nano.split_reads(_nano(spark, sf), [])


def nano_skip(spark: SparkSession, sf: str) -> DataFrame:
    """P-9, P-15: the first header without channel or start time."""
    name = F.col("name")
    bad = C.header_value(name, "ch").isNull() | C.header_time(name).isNull()
    return _long(spark, sf).where(bad).agg(F.min_by("name", "read_idx").alias("name"), F.min("read_idx").alias("read_idx"), F.count("*").alias("n"))


def tech_sniff(spark: SparkSession, sf: str) -> DataFrame:
    """S-10 to S-12: what the headers of each table look like."""
    both = _short(spark, sf).select(F.lit("short").alias("table"), "name").unionByName(_long(spark, sf).select(F.lit("long").alias("table"), "name"))
    kind = F.when(C.is_illumina(F.col("name")), "illumina").when(C.is_nanopore(F.col("name")), "nanopore").otherwise("unknown")
    return both.where("name is not null").groupBy("table", kind.alias("technology")).agg(F.count("*").alias("n"))


def canonical_kmers(spark: SparkSession, sf: str) -> DataFrame:
    """P-18: canonical 13-mers of adapters."""
    own = load(spark, sf, "adapters").select("adapter_id", C.norm(F.col("sequence")).alias("s"))
    return own.select("adapter_id", F.explode(identify.canonical_kmers(F.col("s"))).alias("kmer"))


def _library(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "adapters").select(F.concat_ws(" ", F.trim("name"), "adapter_id").alias("name"), "sequence")


def _frequent(spark: SparkSession, sf: str) -> DataFrame:
    return overrepresented(spark, sf).select(F.col("fragment").alias("query")).distinct()


def kmer_match(spark: SparkSession, sf: str) -> DataFrame:
    """J-5, A-37: adapters that share k-mers with overrepresented fragments."""
    return identify.kmer_matches(_frequent(spark, sf), _library(spark, sf))


def _mate_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return mate_overrepresented(spark, sf).select(F.col("fragment").alias("query")).distinct()


def mate_kmer_match(spark: SparkSession, sf: str) -> DataFrame:
    """J-5, A-37 with every 8th read of each mate: adapters that share k-mers with overrepresented fragments."""
    return identify.kmer_matches(_mate_frequent(spark, sf), _library(spark, sf))


def seq_identity(spark: SparkSession, sf: str) -> DataFrame:
    """J-6: what overrepresented fragments of either mate are."""
    return identify.identified(_mate_frequent(spark, sf), _library(spark, sf))


def header_fields(spark: SparkSession, sf: str) -> DataFrame:
    """P-8 to P-11: what the headers of long reads hold."""
    name = F.col("name")
    return _long(spark, sf).select(
        "read_idx", C.whole_number(C.header_value(name, "ch")).alias("channel"), F.unix_timestamp(C.header_time(name)).alias("start"), C.read_id(name).alias("id"), C.uuid_number(C.read_id(name)).cast("string").alias("number")
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that fail to parse, each with the first reason."""
    return rejects.rejected(load(spark, sf, "raw_records"))


def p3_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are valid, as rows."""
    return rejects.accepted(load(spark, sf, "raw_records"))


def _writable(spark: SparkSession, sf: str) -> DataFrame:
    """Reads that FASTQ can hold."""
    return _short(spark, sf).where("name is not null and length(sequence) = length(qualities)").select("name", "sequence", "qualities")


def _as_fastq(spark: SparkSession, sf: str, compression: str, split_bytes: int) -> DataFrame:
    folder = scratch_path(spark, "fastq")
    sinks.write_fastq(_writable(spark, sf), folder, compression)
    return read_fastq(spark, folder, split_bytes)


def source_fastq(spark: SparkSession, sf: str) -> DataFrame:
    """S-1, S-3, S-20: short reads written as FASTQ and read back in small splits."""
    return _as_fastq(spark, sf, "none", 1 << 20).select("name", "sequence", "qualities")


def source_fastq_places(spark: SparkSession, sf: str) -> DataFrame:
    """S-3: places of records in their files, which are numbered across splits without gaps."""
    files = _as_fastq(spark, sf, "none", 1 << 20).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("read_idx").alias("places"), F.max("read_idx").alias("last"))
    return files.agg(F.sum("n").alias("records"), F.sum("places").alias("places"), F.bool_and(F.col("last") + 1 == F.col("n")).alias("whole"))


def source_fastq_gz(spark: SparkSession, sf: str) -> DataFrame:
    """S-1, S-2: short reads written as compressed FASTQ and read back."""
    return _as_fastq(spark, sf, "gzip", 1 << 20).select("name", "sequence", "qualities")


def source_bam(spark: SparkSession, sf: str) -> DataFrame:
    """S-5, S-6, S-13: long reads written as BAM and read back in small splits."""
    folder = scratch_path(spark, "bam")
    own = _long(spark, sf).where("name is not null").select(C.read_id(F.col("name")).alias("name"), "sequence", "qualities", "tags")
    sinks.write_bam(own, folder, "@HD\tVN:1.6\n@RG\tID:a\tPL:ONT\n")
    return read_bam(spark, folder, 1 << 16).select("name", "sequence", "qualities", F.hex("tags").alias("tags"), "channel")


def source_fasta(spark: SparkSession, sf: str) -> DataFrame:
    """S-8: adapters written as FASTA and read back."""
    folder = scratch_path(spark, "fasta")
    sinks.write_fasta(load(spark, sf, "adapters").select(F.concat_ws(" ", F.trim("name"), "adapter_id").alias("name"), "sequence"), folder)
    return small.library(spark, folder)


def source_adapters(spark: SparkSession, sf: str) -> DataFrame:
    """S-9: adapters written as a tab-separated list and read back for one technology."""
    folder = scratch_path(spark, "adapters")
    sinks.write_adapters(load(spark, sf, "adapters").withColumn("name", F.trim("name")), folder)
    return small.adapters_table(spark, folder, "nanopore")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        base_counts, phred_counts, end_base_counts, end_phred_counts, front_base_counts, long_base_counts, gc_hist, gc_smooth, mean_phred_hist, q_thresholds, summary, summary_cube,
        length_dist, length_percentiles, n50_n90, quality_fractions, end_quality_fractions, quality_percentiles, long_quality_percentiles, base_content, n_content,
        adapter_hits, adapter_hits_long, adapter_curve, adapter_curve_front, adapter_curve_end, tile_errors, tile_deviation, tile_flags, tile_skip,
        mate_fragment_counts, mate_fragment_totals, mate_fragment_first_come, mate_overrepresented, mate_kmer_match,
        fragment_counts, fragment_totals, fragment_first_come, overrepresented, fingerprint_counts, pair_fingerprint_counts, fingerprint_subsample, fingerprint_subsample_parity, fingerprint_errors, exact_duplicates, mean_phred_parity, adapter_presence, duplication_hist, duplication_remaining, duplication_buckets,
        mate_join, mate_zip, insert_sizes, overlap_adapters, top_adapter_per_length, nano_slots, nano_channels, translocation, split_reads, nano_skip, tech_sniff, canonical_kmers, kmer_match, seq_identity, header_fields,
        source_fastq, source_fastq_places, source_fastq_gz, source_bam, source_fasta, source_adapters,
        p3_found, p3_loaded,
    )}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
