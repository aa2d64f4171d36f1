"""FASTQ files as a data source: ``spark.read.format("fastq").load(path)``.

Plain files are cut into byte ranges; a task finds the first record that begins
in its range and reads on to the end of the last one that does.  So are files of
compressed blocks.  Other compressed files are read by one task each.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqlume.sources.splits import BLOCKS, SPLIT_BYTES, Split, open_binary, plan

COUNTS = "path string, split int, n long"
SCHEMA = "path string, split int, row long, name string, sequence string, qualities string, tags binary"
BLOCK = 8 << 20


def parse(block: bytes) -> tuple[list[bytes], list[bytes], list[bytes], int]:
    """Names, sequences and qualities of the complete records of ``block``, and the bytes they take.

    Raises ValueError for what is no record.
    """
    data = np.frombuffer(block, np.uint8)
    if len(data) and data.max() > 127:
        at = int(np.argmax(data > 127))
        raise ValueError(f"only ASCII is allowed; byte {at} is a non-ASCII character ({chr(data[at])})")
    ends = np.flatnonzero(data == 10)
    if len(ends) and ends[0] and (data[ends[ends > 0] - 1] == 13).any():
        raise ValueError("Lines end in carriage return and line feed; only line feeds are allowed")
    whole = len(ends) // 4
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.empty(0, np.int64)
    # Also an unfinished record is checked as far as it goes.
    heads = np.append(starts[::4], (ends[-1] + 1) if len(ends) and len(ends) % 4 == 0 else []) if len(ends) else np.array([0])
    for which, places, sign in (("a record should start with @", heads, 64), ("the third line of a record should start with +", np.append(starts[2::4], (ends[-1] + 1) if len(ends) % 4 == 2 else []), 43)):
        places = places[places < len(data)].astype(np.int64)
        wrong = places[data[places] != sign]
        if len(wrong):
            raise ValueError(f"{which} but with {chr(data[wrong[0]])} this one does")
    s, e = starts[: whole * 4].reshape(-1, 4), ends[: whole * 4].reshape(-1, 4)
    size = e - s
    uneven = np.flatnonzero(size[:, 1] != size[:, 3]) if whole else []
    if len(uneven):
        i = int(uneven[0])
        raise ValueError(f"sequence and qualities must have equal length; they have not in {block[s[i, 0] + 1 : e[i, 0]].decode('ascii')!r}")
    columns = [[block[a:b] for a, b in zip((s[:, i] + skip).tolist(), e[:, i].tolist(), strict=True)] for i, skip in ((0, 1), (1, 0), (3, 0))]
    return columns[0], columns[1], columns[2], int(e[-1, 3]) + 1 if whole else 0


def first_record(block: bytes) -> int | None:
    """Where the first record begins after the first line end of ``block``.

    A header is followed, two lines on, by a plus; a line of scores that begins
    with @ is followed by a sequence there, which never begins with one.
    """
    at = block.find(b"\n") + 1
    lines = []
    while at > 0 and len(lines) < 12:
        lines.append(at)
        at = block.find(b"\n", at) + 1
    for i, start in enumerate(lines[:-2]):
        if block[start : start + 1] == b"@" and block[lines[i + 2] : lines[i + 2] + 1] == b"+":
            return start
    return None


def _begin(stream: io.BufferedIOBase, start: int) -> int | None:
    """Where the first record at or after ``start`` begins, or None if none does."""
    if not start:
        return 0
    # One byte earlier, so that a record that begins right at the start is seen as following a line end.
    stream.seek(start - 1)
    window = b""
    while True:
        more = stream.read(1 << 16)
        window += more
        skip = first_record(window)
        if skip is not None or not more:
            return None if skip is None else start - 1 + skip


def _of_blocks(split: Split) -> Iterator[tuple[list[bytes], list[bytes], list[bytes]]]:
    """Records of a range of compressed blocks.

    A record belongs to the block that holds the byte before it, so a task knows
    its first record by the first line end it sees.
    """
    from seqlume.sources.bam import Blocks

    stream = Blocks(split.path, split.start)
    if stream.next >= split.stop:
        return
    rest, outside, begun = b"", b"", not split.start
    while stream.next < split.stop and stream.load():
        piece = stream.take()
        if stream.offsets[-1] >= split.stop:  # empty blocks are passed over
            outside = piece
            break
        rest += piece
        if not begun:
            skip = first_record(rest)
            if skip is None:
                continue
            rest, begun = rest[skip:], True
        if len(rest) >= BLOCK:
            names, sequences, qualities, used = parse(rest)
            rest = rest[used:]
            if names:
                yield names, sequences, qualities
    if not begun:  # the first record is told by lines of blocks to come
        held, rest = len(rest), rest + outside
        while (skip := first_record(rest)) is None and stream.load():
            rest += stream.take()
        if skip is None or skip > held:
            return
        rest, inside = rest[skip:], held - skip
    else:
        inside, rest = len(rest), rest + outside
    # The last record goes on in the blocks that follow, or begins with them.
    names, sequences, qualities, used = parse(rest[:inside])
    if names:
        yield names, sequences, qualities
    rest, inside = rest[used:], inside - used
    while rest.count(b"\n") < 4:
        if not stream.load():
            break
        rest += stream.take()
    if rest.count(b"\n") >= 4:
        end = -1
        for _ in range(4):
            end = rest.index(b"\n", end + 1)
        names, sequences, qualities, _ = parse(rest[: end + 1])
        yield names, sequences, qualities
    elif rest:
        raise EOFError(f"the file ends in an incomplete record: {rest[:2000].decode('ascii', 'replace')}")


def count(split: Split) -> int:
    """Records that begin within a split: the line ends between its first record and the next split's, without building rows."""
    if split.compression == BLOCKS:
        return sum(len(names) for names, _, _ in _of_blocks(split))
    with open_binary(split.path, split.compression) as stream:
        if split.compression:
            lines = 0
            while more := stream.read(BLOCK):
                lines += more.count(b"\n")
            return lines // 4
        size = stream.seek(0, 2)
        at = _begin(stream, split.start)
        end = _begin(stream, split.stop) if split.stop < size else size
        if at is None or at >= split.stop:
            return 0
        end = size if end is None else end
        stream.seek(at)
        lines = 0
        while at < end:
            more = stream.read(min(BLOCK, end - at))
            if not more:
                break
            lines += more.count(b"\n")
            at += len(more)
        return lines // 4


def blocks(split: Split) -> Iterator[tuple[list[bytes], list[bytes], list[bytes]]]:
    """The records that begin within a split, block by block."""
    if split.compression == BLOCKS:
        yield from _of_blocks(split)
        return
    with open_binary(split.path, split.compression) as stream:
        rest, at = b"", split.start
        if split.start:
            at = _begin(stream, split.start)
            if at is None or at >= split.stop:
                return
            stream.seek(at)
        while True:
            room = BLOCK if split.compression else min(BLOCK, max(1 << 16, split.stop - at - len(rest)))
            more = stream.read(room)
            block = rest + more
            names, sequences, qualities, used = parse(block)
            if not split.compression and at + used > split.stop:
                # Records that begin past the end belong to the next split.
                place, keep = at, 0
                for n, s in zip(names, sequences, strict=True):
                    if place >= split.stop:
                        break
                    keep += 1
                    place = at + _end_of(block, place - at, len(n), len(s))
                yield names[:keep], sequences[:keep], qualities[:keep]
                return
            if names:
                yield names, sequences, qualities
            rest = block[used:]
            at += used
            if not split.compression and at >= split.stop:
                return
            if not more:
                if rest:
                    raise EOFError(f"the file ends in an incomplete record: {rest[:2000].decode('ascii', 'replace')}")
                return


def _end_of(block: bytes, start: int, name: int, sequence: int) -> int:
    """Where a record ends; its third line may repeat the name."""
    third = start + name + 2 + sequence + 1
    return block.index(b"\n", third) + 1 + sequence + 1


def to_batch(path: str, split: int, row: int, names: list[bytes], sequences: list[bytes], qualities: list[bytes], tags: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(names)
    text = [pa.array(x, pa.binary()).cast(pa.string()) for x in (names, sequences, qualities)]
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n, pa.string()), pa.array(np.full(n, split, np.int32)), pa.array(np.arange(row, row + n)), *text, pa.array(tags if tags is not None else [b""] * n, pa.binary())],
        names=["path", "split", "row", "name", "sequence", "qualities", "tags"],
    )


class _Partition(InputPartition):
    def __init__(self, split: Split):
        super().__init__(split)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.counts = options.get("counts") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Partition(s) for s in plan(self.path, self.split_bytes)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        split, row = partition.value, 0
        if self.counts:
            yield pa.RecordBatch.from_arrays([pa.array([split.path]), pa.array([split.number], pa.int32()), pa.array([count(split)])], names=["path", "split", "n"])
            return
        for names, sequences, qualities in blocks(split):
            yield to_batch(split.path, split.number, row, names, sequences, qualities)
            row += len(names)


class FastqSource(DataSource):
    """Options: ``path`` (file, folder or pattern), ``splitBytes``, and ``counts`` for the number of records by split only."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return COUNTS if dict(self.options).get("counts") == "true" else SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def numbered(records: DataFrame, counts: DataFrame) -> DataFrame:
    """``records`` with ``read_idx``, the place of a record in its file.

    ``counts`` has ``path``, ``split`` and ``n``, the records of each split.  A split
    starts after those before it: one small table, three numbers for each 128 MB
    of input, which is broadcast.  Nothing runs before the result is asked for.
    """
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.xxhash64("path").alias("_file"), "split", "base")
    tagged = records.withColumn("_file", F.xxhash64("path"))
    return tagged.join(F.broadcast(starts), ["_file", "split"]).withColumn("read_idx", F.col("base") + F.col("row")).drop("base", "_file")


def read_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads of FASTQ files with ``read_idx``, and ``sample``, the file's name."""
    spark.dataSource.register(FastqSource)
    raw = spark.read.format("fastq").option("path", path).option("splitBytes", split_bytes).load()
    if all(s.number == 0 for s in plan(path, split_bytes)):
        records = raw.withColumn("read_idx", F.col("row"))
    else:
        counts = spark.read.format("fastq").option("path", path).option("splitBytes", split_bytes).option("counts", "true").load()
        records = numbered(raw, counts)
    return records.withColumn("sample", F.element_at(F.split("path", "/"), -1))
