"""BAM files as a data source: ``spark.read.format("bam").load(path)``.

Files are made of small compressed blocks, so they are cut into ranges of
compressed bytes: a task finds the first block that begins in its range, and in
it the first place from which several sound records follow each other.  Files
compressed in any other way are read by one task each.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqlume.functions.columns import uuid_valid
from seqlume.sources.fastq import numbered
from seqlume.sources.splits import SPLIT_BYTES, Split, block_size, compression_of, expand, filesystem, head, open_binary

SCHEMA = "path string, split int, row long, name string, sequence string, qualities string, tags binary, ch long, st string, du float, pi string"
#: What the 4-bit codes of a sequence stand for, and the flags of records to skip.
CODES = "=ACMGRSVTWYHKDBN"
SECONDARY, SUPPLEMENTARY = 256, 2048
BATCH = 5_000

_LETTERS = np.frombuffer(CODES.encode(), np.uint8)
_INTS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def _exactly(stream, size: int) -> bytes:  # noqa: ANN001
    found = b""
    while len(found) < size:
        more = stream.read(size - len(found))
        if not more:
            raise EOFError("the file ends early: truncated BAM")
        found += more
    return found


def read_references(stream) -> tuple[str, int]:  # noqa: ANN001
    """The header's text and the number of references; the stream is then at the first record."""
    first = _exactly(stream, 8)
    if first[:4] != b"BAM\x01":
        raise ValueError(f"not a BAM file: it begins with {first!r}")
    text = _exactly(stream, struct.unpack("<I", first[4:])[0])
    references = struct.unpack("<I", _exactly(stream, 4))[0]
    for _ in range(references):
        _exactly(stream, struct.unpack("<I", _exactly(stream, 4))[0] + 4)
    return text.rstrip(b"\0").decode("utf-8"), references


def read_header(stream) -> str:  # noqa: ANN001
    """The header's text; the stream is then at the first record."""
    return read_references(stream)[0]


class Blocks:
    """A file of blocks as a stream of decompressed bytes that knows which block a byte is from."""

    def __init__(self, path: str, start: int = 0):
        fs, inner = filesystem(path)
        self.raw = fs.open_input_file(inner)
        self.size = self.raw.size()
        self.next = self._first_block(start)
        self.data, self.at = b"", 0
        self.begins: list[int] = []  # places in ``data`` where blocks begin
        self.offsets: list[int] = []  # and where these are in the file

    def _first_block(self, start: int) -> int:
        """The first block at or after a compressed offset; it is followed by another or the end."""
        if not start:
            return 0
        self.raw.seek(start)
        window = self.raw.read(min(self.size - start, 1 << 18))
        at = window.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            size = block_size(window, at)
            if size and (start + at + size == self.size or block_size(window, at + size)):
                return start + at
            at = window.find(b"\x1f\x8b\x08\x04", at + 1)
        return self.size

    def load(self) -> bool:
        """Decompress one more block; False at the end of the file."""
        while self.next < self.size:
            self.raw.seek(self.next)
            head_bytes = self.raw.read(min(1 << 16, self.size - self.next))
            size = block_size(head_bytes)
            if size is None:
                raise ValueError("a compressed block is broken")
            if len(head_bytes) < size:
                head_bytes += self.raw.read(size - len(head_bytes))
            if len(head_bytes) < size:
                raise EOFError("the file ends early: truncated BAM")
            extra = struct.unpack_from("<H", head_bytes, 10)[0]
            data = zlib.decompress(head_bytes[12 + extra : size - 8], -15)
            offset, self.next = self.next, self.next + size
            if data:
                if self.at > 1 << 20:
                    self._forget()
                self.begins.append(len(self.data))
                self.offsets.append(offset)
                self.data += data
                return True
        return False

    def _forget(self) -> None:
        keep = bisect.bisect_right(self.begins, self.at) - 1
        cut = self.begins[keep]
        self.data, self.at = self.data[cut:], self.at - cut
        self.begins, self.offsets = [b - cut for b in self.begins[keep:]], self.offsets[keep:]

    def block(self) -> int:
        """Where the block of the next byte begins in the file; the file's size at its end."""
        if self.at == len(self.data) and not self.load():
            return self.size
        return self.offsets[bisect.bisect_right(self.begins, self.at) - 1]

    def read(self, size: int) -> bytes:
        while len(self.data) - self.at < size and self.load():
            pass
        found = self.data[self.at : self.at + size]
        self.at += len(found)
        return found

    def take(self) -> bytes:
        """What is decompressed and not yet read."""
        found = self.data[self.at :]
        self.at = len(self.data)
        return found

    def align(self, references: int, chain: int = 4) -> bool:
        """Go to the first place from which ``chain`` sound records, or all that are left, follow."""
        while True:
            if self.at == len(self.data) and not self.load():
                return False
            if self._sound(self.at, references, chain):
                return True
            self.at += 1

    def _sound(self, at: int, references: int, chain: int) -> bool:
        for _ in range(chain):
            while len(self.data) < at + 36:
                if not self.load():
                    return len(self.data) == at
            size, ref, pos, name, _, _, cigar, _, length, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", self.data, at)
            if not (name >= 1 and -1 <= ref < references and pos >= -1 and -1 <= next_ref < references and next_pos >= -1 and 0 <= length <= size):
                return False
            if size < 32 + name + 4 * cigar + (length + 1) // 2 + length:
                return False
            while len(self.data) < at + 36 + name:
                if not self.load():
                    return False
            text = self.data[at + 36 : at + 36 + name]
            if text[-1] or any(not 33 <= c <= 126 for c in text[:-1]):
                return False
            at += 4 + size
            while len(self.data) < at:
                if not self.load():
                    return False
        return True


def plan(paths: str, split_bytes: int = SPLIT_BYTES) -> list[Split]:
    """Ranges of compressed bytes of files made of blocks, and other files whole."""
    found = []
    for path in expand(paths):
        fs, inner = filesystem(path)
        size = fs.get_file_info(inner).size
        blocked = block_size(head(path, 64)) is not None
        step = split_bytes if blocked else max(size, 1)
        for number, start in enumerate(range(0, max(size, 1), step)):
            found.append(Split(path, number, start, min(size, start + step), "blocks" if blocked else compression_of(path)))
    return found


def split_records(split: Split) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
    """The primary records that begin in blocks of the split."""
    if split.compression != "blocks":
        with open_binary(split.path, split.compression) as stream:
            read_header(stream)
            yield from records(stream)
        return
    stream = Blocks(split.path)
    _, references = read_references(stream)
    if split.start > stream.block():
        stream = Blocks(split.path, split.start)
        if not stream.align(references):
            return
    elif split.start and stream.block() >= split.stop:
        return
    yield from records(stream, lambda: stream.block() >= split.stop)


def decode_sequence(packed: bytes, length: int) -> bytes:
    pair = np.frombuffer(packed, np.uint8)
    return _LETTERS[np.column_stack([pair >> 4, pair & 15]).ravel()[:length]].tobytes()


def decode_tags(tags: bytes) -> dict[str, object]:
    """The tags ch (any whole number), st, pi (text) and du (float); others are passed over.

    ValueError for an unknown type or tags cut short, RuntimeError for a wanted
    tag of another type.
    """
    found: dict[str, object] = {}
    at = 0
    while at < len(tags):
        if at + 3 > len(tags):
            raise ValueError("truncated tags")
        key, kind = tags[at : at + 2].decode("ascii", "replace"), chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            end = tags.find(b"\0", at)
            if end < 0:
                raise ValueError("truncated tags")
            value: object = tags[at:end].decode("ascii", "replace")
            at = end + 1
        elif kind == "B":
            if at + 5 > len(tags):
                raise ValueError("truncated tags")
            inner = chr(tags[at])
            if inner not in _SIZES or inner == "A":
                raise ValueError(f"unknown tag type {inner!r}")
            at += 5 + _SIZES[inner] * struct.unpack_from("<I", tags, at + 1)[0]
            value = None
        elif kind in _SIZES:
            if at + _SIZES[kind] > len(tags):
                raise ValueError("truncated tags")
            value = chr(tags[at]) if kind == "A" else struct.unpack_from("<" + ("f" if kind == "f" else _INTS[kind]), tags, at)[0]
            at += _SIZES[kind]
        else:
            raise ValueError(f"unknown tag type {kind!r}")
        if at > len(tags):
            raise ValueError("truncated tags")
        wanted = {"ch": kind in _INTS, "st": kind == "Z", "du": kind == "f", "pi": kind == "Z"}
        if key in wanted:
            if not wanted[key]:
                raise RuntimeError(f"tag {key} has type {kind!r}")
            found[key] = value
    return found


def records(stream, done=lambda: False) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:  # noqa: ANN001
    """Name, sequence, qualities and tags of primary records, as they are sequenced in the file."""
    while not done():
        first = stream.read(4)
        if not first:
            return
        while len(first) < 4:
            more = stream.read(4 - len(first))
            if not more:
                raise EOFError(f"the file ends in an incomplete record: {first!r}")
            first += more
        size = struct.unpack("<I", first)[0]
        try:
            body = _exactly(stream, size)
        except EOFError:
            raise EOFError("the file ends in an incomplete record") from None
        name_size, _, _, cigar, flag, length = struct.unpack_from("<BBHHHI", body, 8)
        if flag & (SECONDARY | SUPPLEMENTARY):
            continue
        at = 32
        name = body[at : at + max(0, name_size - 1)]
        at += name_size + 4 * cigar
        sequence = decode_sequence(body[at : at + (length + 1) // 2], length)
        at += (length + 1) // 2
        raw = body[at : at + length]
        qualities = b"!" * length if raw[:1] == b"\xff" else (np.frombuffer(raw, np.uint8) + 33).astype(np.uint8).tobytes()
        yield name, sequence, qualities, body[at + length :]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in plan(self.path, self.split_bytes)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        split, row, held = partition.value, 0, []

        def batch() -> pa.RecordBatch:
            tags = [decode_tags(r[3]) for r in held]
            columns = [pa.array([split.path] * len(held), pa.string()), pa.array(np.full(len(held), split.number, np.int32)), pa.array(np.arange(row, row + len(held)))]
            columns += [pa.array([r[i] for r in held], pa.binary()).cast(pa.string()) for i in range(3)]
            columns += [pa.array([r[3] for r in held], pa.binary())]
            columns += [pa.array([t.get(k) for t in tags], kind) for k, kind in (("ch", pa.int64()), ("st", pa.string()), ("du", pa.float32()), ("pi", pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["path", "split", "row", "name", "sequence", "qualities", "tags", "ch", "st", "du", "pi"])

        for record in split_records(split):
            held.append(record)
            if len(held) == BATCH:
                yield batch()
                row, held = row + len(held), []
        if held:
            yield batch()


class BamSource(DataSource):
    """Options: ``path`` (file, folder or pattern) and ``splitBytes`` (of compressed bytes)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads of BAM files with ``read_idx``, ``sample`` and the nanopore columns from their tags."""
    spark.dataSource.register(BamSource)
    raw = spark.read.format("bam").option("path", path).option("splitBytes", split_bytes).load()
    one = all(s.number == 0 for s in plan(path, split_bytes))
    records = raw.withColumn("read_idx", F.col("row")) if one else numbered(raw, raw.groupBy("path", "split").agg(F.count("*").alias("n")))
    return records.select(
        "read_idx", F.element_at(F.split("path", "/"), -1).alias("sample"), "path", "name", "sequence", "qualities", "tags",
        F.col("ch").alias("channel"), F.try_to_timestamp(F.col("st")).alias("start_time"), F.col("du").alias("duration"), F.when(uuid_valid(F.col("pi")), F.col("pi")).alias("parent_id"),
    )
