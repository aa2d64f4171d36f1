"""Writing reads and small lists in the formats that the sources read."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlume.sources.bam import CODES
from seqlume.sources.splits import filesystem

#: Bytes of a block before compression.
BLOCK = 65_000
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")  # fixed value: the empty block that ends a file
_CODE = np.full(256, CODES.index("N"), np.uint8)
for _i, _letter in enumerate(CODES):
    _CODE[ord(_letter)] = _CODE[ord(_letter.lower())] = _i


def write_fastq(reads: DataFrame, folder: str, compression: str = "none") -> None:
    """``name``, ``sequence`` and ``qualities`` as FASTQ text, a file for each partition.

    Rows with a null among them, or with qualities of another length, cannot be written and raise an error.
    """
    whole = (F.length("sequence") == F.length("qualities")) & F.col("name").isNotNull()
    record = F.concat(F.lit("@"), "name", F.lit("\n"), "sequence", F.lit("\n+\n"), "qualities")
    wrong = F.raise_error(F.lit("a read without name or with qualities of another length cannot be written as FASTQ"))
    reads.select(F.when(whole, record).otherwise(wrong).alias("value")).write.option("compression", compression).text(folder)


def write_fasta(sequences: DataFrame, path: str) -> None:
    """``name`` and ``sequence`` as FASTA text."""
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value")).write.text(path)


def write_adapters(adapters: DataFrame, path: str) -> None:
    """A tab-separated list of ``name``, ``sequencing_technology``, ``sequence`` and ``sequence_position``."""
    adapters.select(F.concat_ws("\t", "name", "sequencing_technology", "sequence", "sequence_position").alias("value")).write.text(path)


def block(data: bytes) -> bytes:
    """One compressed block, as files that can be cut are made of."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = struct.pack("<2sHH", b"BC", 2, len(body) + 25)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


def _record(name: str, sequence: str, qualities: str | None, tags: bytes | None) -> bytes:
    """An unaligned record; qualities that are missing or of another length are left unset."""
    codes = _CODE[np.frombuffer((sequence or "").encode("ascii", "replace"), np.uint8)]
    size = len(codes)
    codes = np.append(codes, np.zeros(size % 2, np.uint8))
    packed = (codes[::2] << 4 | codes[1::2]).tobytes()
    scores = bytes(ord(c) - 33 for c in qualities) if qualities is not None and len(qualities) == size else b"\xff" * size
    title = name.encode("ascii", "replace")[:254] + b"\0"
    body = struct.pack("<iiBBHHHIiii", -1, -1, len(title), 0, 4680, 0, 4, size, -1, -1, 0) + title + packed + scores + bytes(tags or b"")
    return struct.pack("<I", len(body)) + body


def write_bam(reads: DataFrame, folder: str, header: str = "@HD\tVN:1.6\tSO:unknown\n") -> list[tuple[str, int]]:
    """``name``, ``sequence``, ``qualities`` and ``tags`` as unaligned BAM; the files and their numbers of records.

    A file for each partition.  It is written under a name of its own and moved when
    it is whole, so a task that runs again replaces its file and adds none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = filesystem(folder)
        fs.create_dir(inner, recursive=True)
        number = TaskContext.get().partitionId()
        aside, final, n = f"{inner}/_{number}-{uuid.uuid4().hex}", f"{inner}/part-{number:05d}.bam", 0
        with fs.open_output_stream(aside, compression=None) as out:
            held = b"BAM\x01" + struct.pack("<I", len(header)) + header.encode() + struct.pack("<I", 0)
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    held += _record(*row)
                    n += 1
                    while len(held) >= BLOCK:
                        out.write(block(held[:BLOCK]))
                        held = held[BLOCK:]
            if held:
                out.write(block(held))
            out.write(_END)
        fs.move(aside, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64())], names=["path", "n"])

    chosen = reads.select("name", "sequence", "qualities", "tags").where("name is not null")
    return [tuple(r) for r in chosen.mapInArrow(run, "path string, n long").collect()]  # a row a file
