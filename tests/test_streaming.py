from pyspark.sql import functions as F

from seqlume.operators import profile, reads
from seqlume.streaming import metrics


def drain(query_df, spark, name, mode):
    query = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def folder(spark, data, tmp_path):
    short = spark.read.parquet(f"{data}/short_reads.parquet")
    short.repartition(3).write.parquet(str(tmp_path / "in"))
    return short


def test_running_profile_equals_batch(spark, data, tmp_path):
    short = folder(spark, data, tmp_path)
    got = drain(metrics.running_profile(metrics.read_stream(spark, str(tmp_path / "in"), 1), ["mate"]), spark, "profile_so_far", "complete")
    want = profile.profile(short, ["mate"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_summary_equals_batch(spark, data, tmp_path):
    short = folder(spark, data, tmp_path)
    got = drain(metrics.running_summary(metrics.read_stream(spark, str(tmp_path / "in"), 1), ["mate"]), spark, "summary_so_far", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, reads.summary(reads.facts(short, ["mate"]), ["mate"]).collect()))


def test_windows_and_deliveries(spark, data, tmp_path):
    short = folder(spark, data, tmp_path)
    windows = drain(metrics.windowed_summary(metrics.read_stream(spark, str(tmp_path / "in")), ["mate"], late="400 days"), spark, "windows_so_far", "update")
    assert windows.agg(F.sum("reads")).first()[0] == short.where("seen_at is not null").count()
    once = drain(metrics.first_deliveries(metrics.read_stream(spark, str(tmp_path / "in")), late="400 days"), spark, "once", "append")
    assert once.count() == short.select("run_id", "sample", "mate", "name").distinct().count()


def test_fastq_files_arrive(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq").write_bytes(b"@x\nACG\n+\nIII\n@y\nA\n+\nI\n")
    (tmp_path / "in" / "b.fastq.gz").write_bytes(gzip.compress(b"@z\nTT\n+\nII\n"))
    got = drain(metrics.running_profile(metrics.fastq_stream(spark, str(tmp_path / "in"), 1), []), spark, "fastq_so_far", "complete")
    assert got.where("kind = 'base'").agg(F.sum("n")).first()[0] == 6
