import json
import zipfile

import pytest
from pyspark.sql import functions as F

from seqlume import cli, report

SIMPLE = b"@A/1\nGATTACA\n+\nHHHHHHH\n@B/1\nACATTAG\n+\nKKKKKKK\n@C/1\nAAAATTTT\n+\nXKLLCCCC\n"


def run(tmp_path, content, *args, name="in.fastq"):
    (tmp_path / name).write_bytes(content)
    assert cli.main([str(tmp_path / name), *args, "--outdir", str(tmp_path / "out")]) == 0
    return json.loads((tmp_path / "out" / f"{name}.json").read_text())


def test_single_file(spark, tmp_path):
    got = run(tmp_path, SIMPLE, "--images-zip", "i.zip")
    s = got["summary"]
    assert (s["maximum_length"], s["minimum_length"], s["total_gc_bases"], s["total_bases"], s["total_reads"]) == (8, 7, 4, 22, 3)
    d = got["sequence_length_distribution"]
    assert d["n50"] == 7 and d["n90"] == 7 and d["q50"] == 7 and sum(d["counts"]) == 3
    assert got["per_tile_quality"]["skipped_reason"].endswith("A/1") and got["nanopore_metrics"]["skipped_reason"]
    assert list(got) == [k for k in report.ORDER if k in got] and len(got["per_position_base_content"]["A"]) == 8
    assert "<svg" in (tmp_path / "out" / "in.fastq.html").read_text()
    dates = {i.date_time for i in zipfile.ZipFile(tmp_path / "out" / "i.zip").infolist()}
    assert dates == {(1980, 1, 1, 0, 0, 0)}
    assert cli.main([str(tmp_path / "out" / "in.fastq.json"), "--rerender", "--html", "again.html", "--outdir", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out" / "again.html").read_text() == (tmp_path / "out" / "in.fastq.html").read_text()


@pytest.mark.parametrize("content,reads", [(b"", 0), (b"@x\n\n+\n\n", 1), (b"@test\nA\n+\n#\n", 1), (b"@35eb0273-89e2-4093-98ed-d81cbdafcac7 ch=165 start_time=2020-01-01T00:00:00Z\nA\n+\n=\n", 1)])
def test_tiny_files(spark, tmp_path, content, reads):
    got = run(tmp_path, content)
    assert got["summary"]["total_reads"] == reads and got["summary"]["total_gc_bases"] == 0
    if b"ch=" in content:
        assert got["nanopore_metrics"]["skipped_reason"] is None and got["nanopore_metrics"]["total_reads"] == 1


def test_adapters_and_fragments(spark, tmp_path):
    adapter = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
    content = "".join(f"@SIM:1:FC:1:{1000 + i}:{i}:9 1:N:0:2\n{adapter}\n+\n{'?' * 33}\n" for i in range(100)).encode()
    (tmp_path / "a.tsv").write_text("Universal\tillumina\tAGATCGGAAGAG\tend\n")
    (tmp_path / "l.fasta").write_text(f">known\n{adapter}\n")
    got = run(tmp_path, content, "--adapter-file", str(tmp_path / "a.tsv"), "--library", str(tmp_path / "l.fasta"), "--overrepresentation-min-threshold", "5", "--overrepresentation-sample-every", "1")
    assert got["summary"]["q20_reads"] == 100 and got["summary"]["maximum_length"] == 33
    assert got["adapter_content"]["adapter_content"] == [["Universal", [100.0] * 33]]
    over = got["overrepresented_sequences"]
    assert over["total_fragments"] == 200 and [x["best_match"] for x in over["overrepresented_sequences"]] == ["known"] * 2
    assert {x["most_matches"] for x in over["overrepresented_sequences"]} == {21}
    assert got["per_tile_quality"]["skipped_reason"] is None and len(got["per_tile_quality"]["normalized_per_tile_averages"]) == 100
    assert got["duplication_fractions"]["duplication_counts"] == [[100, 1]]


def test_pairs(spark, tmp_path):
    other = SIMPLE.replace(b"/1\n", b"/2\n")
    (tmp_path / "r2.fastq").write_bytes(other)
    (tmp_path / "r1.fastq").write_bytes(SIMPLE)
    assert cli.main([str(tmp_path / "r1.fastq"), str(tmp_path / "r2.fastq"), "--outdir", str(tmp_path)]) == 0
    got = json.loads((tmp_path / "r1.fastq.json").read_text())
    assert "adapter_content" not in got and got["summary"]["read_pair_info"] == "Read 1" and got["summary_read2"]["read_pair_info"] == "Read 2"
    assert got["insert_size_metrics"]["insert_sizes"] == [3] and got["per_tile_quality_read2"]["read_pair_info"] == "Read 2"
    for content, message in ((other.replace(b"@B", b"@Z"), "match"), (other[: other.index(b"@C")], "file 1"), (other + b"@D/2\nA\n+\nI\n", "file 2")):
        (tmp_path / "r2.fastq").write_bytes(content)
        with pytest.raises(ValueError, match=message):
            cli.main([str(tmp_path / "r1.fastq"), str(tmp_path / "r2.fastq"), "--outdir", str(tmp_path)])


def test_report_over_a_table(spark, data):
    df = spark.read.parquet(f"{data}/short_reads.parquet").where("mate = 1").withColumn("sample", F.lit("x"))
    got = report.build(df, adapters=[("a", "CGTGTATGGGCT", "end")])
    assert got["summary"]["total_reads"] == df.count()
    json.dumps(got)


def test_adapters_and_known_sequences_by_default(spark, tmp_path):
    adapter = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
    content = "".join(f"@SIM:1:FC:1:{1000 + i}:{i}:9 1:N:0:2\n{adapter}\n+\n{'?' * 33}\n" for i in range(100)).encode()
    got = run(tmp_path, content, "--overrepresentation-min-threshold", "5", "--overrepresentation-sample-every", "1")
    assert dict(got["adapter_content"]["adapter_content"])["Illumina Universal Adapter"] == [100.0] * 33
    assert len(got["adapter_content"]["adapter_content"]) == 6
    assert all("TruSeq" in x["best_match"] for x in got["overrepresented_sequences"]["overrepresented_sequences"])
    assert got["summary"]["read_pair_info"] is None and "reads_above" not in got["per_sequence_quality_scores"]
    drawn = report.plots(got)["adapter_content_adapter_content"]
    assert "Illumina Universal Adapter" in drawn and "PolyG" not in drawn
