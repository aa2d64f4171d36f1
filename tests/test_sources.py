import bz2
import gzip
import lzma
import random
import struct

import pytest

from seqlume.sources import bam, fastq, small, splits


def record(i, name="r"):
    rnd = random.Random(i)
    size = rnd.choice([0, 1, 5, 40, 200])
    return f"{name}{i}", "".join(rnd.choice("ACGTN") for _ in range(size)), "".join(chr(rnd.choice([64, 43, rnd.randint(33, 126)])) for _ in range(size))


def text(records, third=""):
    return "".join(f"@{n}\n{s}\n+{third and n}\n{q}\n" for n, s, q in records).encode()


@pytest.mark.parametrize("size", [1, 7, 50, 333, 1000, 10**6])
@pytest.mark.parametrize("third", ["", "name"])
def test_every_split_has_each_record_once(tmp_path, size, third):
    records = [record(i, "@+odd" if i % 3 == 0 else "r") for i in range(60)]
    path = tmp_path / "a.fastq"
    path.write_bytes(text(records, third))
    got = []
    for split in splits.plan(str(path), size):
        for names, sequences, qualities in fastq.blocks(split):
            got += [(n.decode(), s.decode(), q.decode()) for n, s, q in zip(names, sequences, qualities, strict=True)]
    assert got == records


@pytest.mark.parametrize("pack,end", [(gzip.compress, ".gz"), (bz2.compress, ".bz2"), (lzma.compress, ".xz"), (bytes, "")])
def test_read_fastq(spark, tmp_path, pack, end):
    records = [record(i) for i in range(500)]
    (tmp_path / f"a.fastq{end}").write_bytes(pack(text(records)))
    (tmp_path / f"b.fastq{end}").write_bytes(pack(text(records[:3])))
    df = fastq.read_fastq(spark, str(tmp_path), split_bytes=4_000)
    for sample, want in (("a", records), ("b", records[:3])):
        rows = df.where(f"sample = '{sample}.fastq{end}'").orderBy("read_idx").collect()
        assert [r.read_idx for r in rows] == list(range(len(want)))
        assert [(r["name"], r["sequence"], r["qualities"]) for r in rows] == want


def test_whole_and_cut_gzip_members(spark, tmp_path):
    path = tmp_path / "a.fastq.gz"
    path.write_bytes(gzip.compress(text([record(1)])) + gzip.compress(text([record(2)])))
    assert fastq.read_fastq(spark, str(path)).count() == 2


@pytest.mark.parametrize("content,message", [
    (b"not a record", "start with @ but with n"), (b"@n\nSEQ\n-\n", "start with \\+ but with -"), (b"@n\nAGA\n+\nGG\n", "equal length"), ("@nÄ\nA\n+\nI\n".encode("latin-1"), "non-ASCII"), (b"@n\r\nA\r\n+\r\nI\r\n", "carriage"),
])
def test_malformed_fastq(content, message):
    with pytest.raises(ValueError, match=message):
        fastq.parse(content)


def test_truncated_fastq(tmp_path):
    whole = b"@SOMEHEADER METADATA\nAGA\n+\nGGG\n"
    path = tmp_path / "a.fastq"
    for end in range(1, len(whole)):
        path.write_bytes(whole[:end])
        with pytest.raises(EOFError, match="ncomplete record"):
            list(fastq.blocks(splits.plan(str(path))[0]))
    path.write_bytes(b"")
    assert list(fastq.blocks(splits.plan(str(path))[0])) == []


def bam_bytes(records, header="@HD\tVN:1.6\n@RG\tID:a\tPL:ONT\n", refs=(("chr1", 1000),)):
    out = b"BAM\1" + struct.pack("<I", len(header)) + header.encode() + struct.pack("<I", len(refs))
    for name, size in refs:
        out += struct.pack("<I", len(name) + 1) + name.encode() + b"\0" + struct.pack("<I", size)
    for name, sequence, qualities, tags, flag in records:
        codes = [bam.CODES.index(c) for c in sequence] + [0] * (len(sequence) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        raw = b"\xff" * len(sequence) if qualities is None else bytes(ord(c) - 33 for c in qualities)
        body = struct.pack("<iiBBHHHIiii", -1, -1, len(name) + 1, 0, 0, 2, flag, len(sequence), -1, -1, 0) + name.encode() + b"\0" + b"\0" * 8 + packed + raw + tags
        out += struct.pack("<I", len(body)) + body
    return out


TAGS = b"chS" + struct.pack("<H", 300) + b"stZ2020-03-01T00:00:00Z\0" + b"duf" + struct.pack("<f", 2.5) + b"piZ35eb0273-89e2-4093-98ed-d81cbdafcac7\0" + b"xxBS" + struct.pack("<IHH", 2, 1, 2) + b"yyAq"


def test_read_bam(spark, tmp_path):
    records = [("a", "ACGTN", "IIIII", TAGS, 4), ("b", "", "", b"", 4), ("s", "AC", "II", b"", 256), ("u", "AC", "II", b"", 2048), ("both", "AC", "II", b"", 2304), ("c", "=ACMGRSVTWYHKDBN", None, b"", 1663)]
    path = tmp_path / "x.bam"
    path.write_bytes(gzip.compress(bam_bytes(records[:2]))[:0] + gzip.compress(bam_bytes(records)))
    rows = bam.read_bam(spark, str(path)).orderBy("read_idx").collect()
    assert [(r["name"], r["sequence"], r["qualities"]) for r in rows] == [("a", "ACGTN", "IIIII"), ("b", "", ""), ("c", "=ACMGRSVTWYHKDBN", "!" * 16)]
    assert rows[0].channel == 300 and rows[0].duration == 2.5 and rows[0].parent_id.startswith("35eb") and rows[0].start_time.isoformat() == "2020-03-01T00:00:00"
    assert rows[1].channel is None and bytes(rows[0].tags) == TAGS
    assert small.technology(str(path)) == "nanopore" and small.is_bam(str(path))


def blocks_of(content, size):
    """Content as compressed blocks, the way BAM files are written, with the empty block at the end."""
    import zlib

    out = b""
    for start in [*range(0, len(content), size), None]:
        part = b"" if start is None else content[start : start + size]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize("block", [50, 333, 5000, 60_000])
@pytest.mark.parametrize("split", [40, 700, 5000, 10**6])
def test_every_bam_split_has_each_record_once(tmp_path, block, split):
    rnd = random.Random(block)
    rows = []
    for i in range(150):
        size = rnd.choice([0, 1, 30, 151, 900])
        rows.append((f"read{i}", "".join(rnd.choice("ACGTN") for _ in range(size)), "".join(chr(rnd.randint(33, 126)) for _ in range(size)), TAGS if i % 2 else b"", 4 if i % 7 else 256))
    path = tmp_path / "x.bam"
    path.write_bytes(blocks_of(bam_bytes(rows, refs=tuple((f"chr{i}", 1000) for i in range(30))), block))
    got = [r[0].decode() for s in bam.plan(str(path), split) for r in bam.split_records(s)]
    assert got == [r[0] for r in rows if r[4] == 4]


def test_read_split_bam(spark, tmp_path):
    rows = [(f"r{i}", "ACGT" * (i % 50), "I" * (4 * (i % 50)), b"", 4) for i in range(2000)]
    (tmp_path / "x.bam").write_bytes(blocks_of(bam_bytes(rows), 4000))
    got = bam.read_bam(spark, str(tmp_path / "x.bam"), 2000).orderBy("read_idx").collect()
    assert [(r.read_idx, r["name"], r["sequence"]) for r in got] == [(i, n, s) for i, (n, s, _, _, _) in enumerate(rows)]
    assert small.technology(str(tmp_path / "x.bam")) == "nanopore"


def test_truncated_bam(tmp_path):
    import io

    whole = bam_bytes([("a", "ACGT", "IIII", TAGS, 4)])
    for end in range(len(whole)):
        stream = io.BytesIO(whole[:end])
        try:
            bam.read_header(stream)
            rows = list(bam.records(stream))
        except EOFError:
            continue
        assert not rows and end == len(bam_bytes([]))
    with pytest.raises(ValueError, match="not a BAM"):
        bam.read_header(io.BytesIO(b"SAM\1" + b"\0" * 20))


@pytest.mark.parametrize("tags,error", [(b"chZx\0", RuntimeError), (b"stS\0\0", RuntimeError), (b"xxQ0", ValueError), (b"chI\0", ValueError), (b"stZabc", ValueError), (b"xxBc\5\0\0\0\1", ValueError), (b"ch", ValueError)])
def test_bad_tags(tags, error):
    with pytest.raises(error):
        bam.decode_tags(tags)


@pytest.mark.parametrize("kind,fmt", [("c", "b"), ("C", "B"), ("s", "h"), ("S", "H"), ("i", "i"), ("I", "I")])
def test_channel_of_any_whole_type(kind, fmt):
    assert bam.decode_tags(b"ch" + kind.encode() + struct.pack("<" + fmt, 77)) == {"ch": 77}


def test_fasta_and_adapters(spark, tmp_path):
    (tmp_path / "l.fasta").write_text(">a x\nACG\nT\n\n>b\ngat\n>a x\nTTT\n")
    assert list(small.fasta(str(tmp_path / "l.fasta"))) == [("a x", "ACGT"), ("b", "gat"), ("a x", "TTT")]
    assert {r["name"]: r["sequence"] for r in small.library(spark, str(tmp_path / "l.fasta")).collect()} == {"a x": "TTT", "b": "gat"}
    (tmp_path / "a.tsv").write_text("# c\n\nn1\tillumina\tACGT\tend\nn2\tnanopore\tAA\tstart\nn3\tall\tCC\tend\n")
    assert [a[0] for a in small.adapters(str(tmp_path / "a.tsv"), "illumina")] == ["n1", "n3"]
    assert small.adapters_table(spark, str(tmp_path / "a.tsv")).count() == 3
    (tmp_path / "b.tsv").write_text("n\tall\tA\tmiddle\n")
    with pytest.raises(ValueError, match="middle"):
        small.adapters(str(tmp_path / "b.tsv"))


def test_technology_of_bam_headers():
    assert small.bam_technology("@HD\n@RG\tID:1\tPL:illumina\n@RG\tPL:Illumina\tDT:2020-01-01T00:00:00") == "illumina"
    assert small.bam_technology("@RG\tPL:PACBIO") is None


@pytest.mark.parametrize("size", [1, 7, 50, 333, 1000, 10**6])
def test_counts_of_splits_are_those_of_their_records(tmp_path, size):
    path = tmp_path / "a.fastq"
    path.write_bytes(text([record(i, "@+odd" if i % 3 == 0 else "r") for i in range(60)], "name"))
    for split in splits.plan(str(path), size):
        assert fastq.count(split) == sum(len(names) for names, _, _ in fastq.blocks(split))


def test_reading_is_lazy(spark, tmp_path):
    path = tmp_path / "a.fastq"
    path.write_bytes(text([record(i) for i in range(50)]) + b"broken\n")
    df = fastq.read_fastq(spark, str(path), split_bytes=500)  # nothing is parsed yet
    assert "read_idx" in df.columns
    with pytest.raises(Exception, match="start with @ but with b"):
        df.collect()


def test_defaults():
    from seqlume.sources import defaults

    assert {a[3] for a in defaults.ADAPTERS} == {"start", "end"} and all(len(a[2]) == 12 for a in defaults.ADAPTERS)
    assert [a[0] for a in defaults.adapters("illumina")][:2] == ["Illumina Universal Adapter", "Illumina Small RNA 3' adapter"] and len(defaults.adapters()) == 20
    assert all(set(s) <= set("ACGT") and len(s) >= 20 for s in defaults.known_sequences().values())


@pytest.mark.parametrize("block", [30, 333, 5000, 60_000])
@pytest.mark.parametrize("split", [40, 700, 5000, 10**6])
def test_every_split_of_blocks_has_each_record_once(tmp_path, block, split):
    records = [record(i, "@+odd" if i % 3 == 0 else "r") for i in range(120)]
    path = tmp_path / "a.fastq.gz"
    path.write_bytes(blocks_of(text(records), block) + blocks_of(text(records[:5], "name"), block))
    got = []
    for one in splits.plan(str(path), split):
        assert one.compression == splits.BLOCKS
        found = [(n.decode(), s.decode(), q.decode()) for names, sequences, qualities in fastq.blocks(one) for n, s, q in zip(names, sequences, qualities, strict=True)]
        assert fastq.count(one) == len(found)
        got += found
    assert got == records + records[:5]
    path.write_bytes(blocks_of(text(records)[:-9], block))
    with pytest.raises(EOFError, match="ncomplete record"):
        [list(fastq.blocks(s)) for s in splits.plan(str(path), split)]


def test_sinks(spark, tmp_path):
    from seqlume.sources import sinks

    rows = [("a b", "ACGTn", "IIIII", b"chS\x05\x00"), ("c", "", "", None), ("d", "acg", None, b""), ("e", "ACx", "I", b"")]
    df = spark.createDataFrame(rows, "name string, sequence string, qualities string, tags binary").repartition(2)
    assert sum(n for _, n in sinks.write_bam(df, str(tmp_path / "bam"))) == 4
    got = {r["name"]: (r["sequence"], r["qualities"], r.channel) for r in bam.read_bam(spark, str(tmp_path / "bam")).collect()}
    assert got == {"a b": ("ACGTN", "IIIII", 5), "c": ("", "", None), "d": ("ACG", "!!!", None), "e": ("ACN", "!!!", None)}
    with pytest.raises(Exception, match="cannot be written"):
        sinks.write_fastq(df, str(tmp_path / "fastq"))
