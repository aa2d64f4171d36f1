"""Cutting lineage through the shared folder named in ``spark.checkpoint.dir``.

Intermediate tables go to that folder as Parquet, so that losing an executor
never loses the only copy of a result.  A folder of our own is made only where
the setting is absent, as in local tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[object, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; read from the session, else our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="seqlume-")
    return _own[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, deleted with the scratch tables."""
    path = f"{shared_folder(spark)}/seqlume-scratch/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return it read back.

    Unlike ``DataFrame.checkpoint`` the plan runs once, under AQE, and the
    files are compressed columns, which later readers can prune.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer tasks than there are cores, dealt out to all of them.

    For costly Python stages over small files; a table of as many splits as
    cores, so any large one, is left as it is and not shuffled.  So is what is
    more than a scan: its exchanges already deal it out.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.getClass().getSimpleName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = plan.execute().getNumPartitions()
    return df.repartition(cores) if tasks < cores else df


def drop_scratch() -> None:
    """Delete every scratch table written so far (best effort)."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


atexit.register(drop_scratch)
