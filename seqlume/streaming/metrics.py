"""Metrics over streams of reads.

All counts are sums, so a stream keeps them as running state: by position for
a whole run, and in windows of event time with a watermark for late reads.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlume.operators import profile, reads
from seqlume.sources import fastq

READS = "read_idx long, run_id string, sample string, mate int, name string, sequence string, qualities string, tags binary, seen_at timestamp, loaded_at timestamp"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 16, schema: str = READS) -> DataFrame:
    """Reads that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def fastq_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Reads of FASTQ files, plain or gzip, that arrive in a folder: ``path``, ``row``, ``name``, ``sequence``, ``qualities``.

    A file is one value, so files are to be of moderate size.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                names, sequences, qualities, used = fastq.parse(data)
                if used < len(data):
                    raise EOFError(f"Incomplete record at the end of file {path}")
                yield fastq.to_batch(path, 0, 0, names, sequences, qualities).drop_columns(["split", "tags"])

    return files.mapInArrow(run, "path string, row long, name string, sequence string, qualities string")


def running_profile(stream: DataFrame, by: list[str]) -> DataFrame:
    """Counts of bases and scores by position so far; write with outputMode complete or update.

    Each micro-batch adds a count for each position and code, so state grows
    with positions, not with reads.
    """
    return profile.profile(stream, by)


def running_summary(stream: DataFrame, by: list[str]) -> DataFrame:
    """The summary of reads so far, by group."""
    return reads.summary(reads.facts(stream, by), by)


def windowed_summary(stream: DataFrame, by: list[str], time_col: str = "seen_at", width: str = "10 minutes", late: str = "3 days") -> DataFrame:
    """Reads, bases and good reads in windows of event time; reads later than ``late`` are left out.

    Null times have no window and are left out too.
    """
    facts = reads.facts(stream.where(F.col(time_col).isNotNull()).withWatermark(time_col, late), [*by, time_col])
    return facts.groupBy(F.window(time_col, width).alias("window"), *by).agg(
        F.count("*").alias("reads"), F.sum("length").cast("long").alias("bases"), F.count_if(F.col("phred") >= 20).alias("q20_reads")
    ).select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), *by, "reads", "bases", "q20_reads")


def first_deliveries(stream: DataFrame, time_col: str = "loaded_at", late: str = "7 days") -> DataFrame:
    """Reads without those delivered again (same run, sample, mate and header) within ``late``."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["run_id", "sample", "mate", "name"])
