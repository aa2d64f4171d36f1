"""Loading the named tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name``, a Parquet file or folder ``<folder>/<name>.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
