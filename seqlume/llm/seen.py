"""Has this key occurred before?  Approximate membership, then exact lookup.

Keys are told apart by a 64-bit hash.  Earlier keys are kept on disk, in full
and as Bloom filters by shard of the hash space.  A batch of rows goes through
the filters in order of arrival, 16 bytes a row: what a filter rejects is new
for certain and is done.  What it accepts is looked up among full keys on disk;
of those only the ones whose hash is asked for leave the scan.  Each acceptance
that the lookup disproves is logged, and both rates of error are measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.plans.scratch import materialise
from seqlume.plans.skew import lookup

#: Bits of filter a key; with 4 probes some 1.2 % of new keys are accepted.
BITS_PER_KEY = 10
PROBES = 4
#: Bits of one shard's filter at most (4 MB on disk, 32 MB in a worker); more keys mean more shards.
SHARD_BITS = 1 << 25
#: Rows that are asked of a filter together, before they are added to it.
STEP = 1024
#: Bits of the map of asked hashes, for each of them and at most (8 MB as a million words).
ASKED_BITS, MOST_ASKED_BITS = 16, 1 << 26
_BEFORE_ALL = -(1 << 63)


class Bloom:
    """A filter over 64-bit hashes, whole arrays at a time."""

    def __init__(self, bits: int, probes: int = PROBES):
        self.size, self.probes = max(64, bits), probes
        self.bits = np.zeros(self.size, bool)

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            step = (mixed >> np.uint64(32)) | np.uint64(1)
            for i in range(self.probes):
                yield ((mixed & np.uint64(0xFFFFFFFF)) + np.uint64(i) * step) % np.uint64(self.size)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self._places(hashes):
            found &= self.bits[place]
        return found

    def add(self, hashes: np.ndarray) -> None:
        for place in self._places(hashes):
            self.bits[place] = True

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def load(self, packed: bytes) -> None:
        self.bits |= np.unpackbits(np.frombuffer(packed, np.uint8), count=self.size).astype(bool)


@dataclass
class Earlier:
    """Keys met before, as kept on disk: ``keys`` (``hash``, ``key``, each once) and
    ``filters`` (``shard``, ``filter``), of ``bits`` bits each."""

    keys: DataFrame
    filters: DataFrame
    shards: int
    bits: int


def _shard(shards: int) -> Column:
    """The shard of a hash: its upper bits."""
    by = shards.bit_length() - 1
    return F.shiftrightunsigned("hash", 64 - by).cast("int") if by else F.lit(0)


def remember(keys: DataFrame, key: Column, room: int = 0, bits_per_key: int = BITS_PER_KEY) -> Earlier:
    """Write ``keys``, each once, and their filters, which have ``room`` for as many keys more.

    Null and empty keys are left out.  Later batches are judged against the
    result without reading ``keys`` again.
    """
    held = keys.select(key.alias("key")).where("length(key) > 0").select(F.xxhash64("key").alias("hash"), "key").distinct()
    held = materialise(held, "keys")
    total = max(1, held.count() + room)  # from the file footers
    least = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * bits_per_key // SHARD_BITS))
    shards = 1 << (least - 1).bit_length()
    bits = int(1.25 * total * bits_per_key / shards) + 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = -1, Bloom(bits)
        for batch in batches:
            for at, hashes in _by_shard(batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                if at != shard:
                    if shard >= 0:
                        yield row(shard, own)
                    shard, own = at, Bloom(bits)
                own.add(hashes.view(np.uint64))
        if shard >= 0:
            yield row(shard, own)

    def row(shard: int, own: Bloom) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([own.packed()], pa.binary())], names=["shard", "filter"])

    dealt = held.select(_shard(shards).alias("shard"), "hash").repartition("shard").sortWithinPartitions("shard")
    return Earlier(held, materialise(dealt.mapInArrow(run, "shard int, filter binary"), "filters"), shards, bits)


def _by_shard(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Runs of rows of one shard."""
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(shard[a]), *(c[a:b] for c in columns)


def _repeats_here(tagged: DataFrame) -> DataFrame:
    """``hash``, ``at`` and ``again``: does the batch hold an earlier row of this hash?

    A key that fills a third of the rows leaves each batch once, so that no
    shard gets it whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((at, h))
            again = np.zeros(len(h), bool)
            again[order[1:]] = h[order[1:]] == h[order[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(again)], names=["hash", "at", "again"])

    return tagged.mapInArrow(run, "hash long, at long, again boolean")


def _accepted(first: DataFrame, earlier: Earlier) -> DataFrame:
    """Rows whose shard's filter holds their hash already, in order of ``at``."""
    bits = earlier.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = -1, Bloom(bits)
        for batch in batches:
            filters = {s: f for s, f in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True) if f is not None} if batch.column(3).null_count < batch.num_rows else {}
            hashes, ats = [], []
            for s, h, at in _by_shard(*(batch.column(i).to_numpy() for i in range(3))):
                if s != shard:
                    shard, seen = s, Bloom(bits)
                    if s in filters:
                        seen.load(filters[s])
                own = at != _BEFORE_ALL  # the row that brings the filter
                h, at = h[own], at[own]
                for i in range(0, len(h), STEP):
                    part = h[i : i + STEP].view(np.uint64)
                    hit = seen.holds(part)
                    # Within a step rows are in order: later ones of a hash are repeats.
                    order = np.argsort(part, kind="stable")
                    hit[order[1:]] |= part[order[1:]] == part[order[:-1]]
                    seen.add(part)
                    hashes.append(h[i : i + STEP][hit])
                    ats.append(at[i : i + STEP][hit])
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(ats))], names=["hash", "at"])

    rows = first.select(_shard(earlier.shards).alias("shard"), "hash", "at", F.lit(None).cast("binary").alias("filter"))
    brought = earlier.filters.select("shard", F.lit(0).cast("long").alias("hash"), F.lit(_BEFORE_ALL).alias("at"), "filter")
    return rows.unionByName(brought).repartition(earlier.shards, "shard").sortWithinPartitions("shard", "at").mapInArrow(run, "hash long, at long")


def _asked_for(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose ``hash`` may be among those of ``asked``: a map of bits, tested in the scan.

    The map has at most ``MOST_ASKED_BITS``, whatever is asked; a full map lets
    more rows through and loses none.
    """
    size = min(MOST_ASKED_BITS, 1 << (max(64, asked.count() * ASKED_BITS) - 1).bit_length())
    place = F.col("hash").bitwiseAND(F.lit(size - 1))
    word, bit = F.shiftright(place, 6).alias("_word"), place.bitwiseAND(F.lit(63)).cast("int").alias("_bit")
    words = asked.select(word, bit).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    return keys.select("*", word, bit).join(F.broadcast(words), "_word").where(F.getbit("_bits", "_bit") == 1).drop("_word", "_bit", "_bits")


@dataclass
class Judged:
    """What ``judged`` found, over written tables.

    ``repeats`` has the numbers of rows whose key occurred before, ``disproved`` a
    row (number and ``hash``) for each that the filter accepted and the lookup did not.
    """

    repeats: DataFrame
    disproved: DataFrame
    accepted: DataFrame
    clear: DataFrame
    several: DataFrame
    hashes: DataFrame


def judged(rows: DataFrame, key: Column, order_col: str, prior: DataFrame | None = None, prior_key: Column | None = None, bits_per_key: int = BITS_PER_KEY, earlier: Earlier | None = None) -> Judged:
    """Decide for every row of ``rows`` whether its key occurred before.

    ``earlier`` has the keys met before and must have room for these rows; else
    ``prior`` and ``prior_key`` give them and they are remembered first.
    """
    own = rows.select(F.col(order_col).cast("long").alias("at"), key.alias("key")).where("at is not null and length(key) > 0")
    hashed = own.select(F.xxhash64("key").alias("hash"), "at", "key")
    if earlier is None:
        none = rows.sparkSession.createDataFrame([], "key string")
        earlier = remember(none if prior is None else prior, F.col("key") if prior is None else prior_key, rows.count(), bits_per_key)
    marked = _repeats_here(hashed.select("hash", "at"))
    accepted = materialise(_accepted(marked.where("not again"), earlier).unionByName(marked.where("again").select("hash", "at")), "accepted")
    known = earlier.keys.select("hash", F.lit(_BEFORE_ALL).alias("at"), "key")
    # Full keys of the hashes in question; copies of a key are one row before they leave the scan.
    first = materialise(_asked_for(hashed.unionByName(known), accepted).groupBy("hash", "key").agg(F.min("at").alias("first"), F.count("*").alias("rows")), "first")
    # A hash that one key has needs no comparison of keys; others do.
    alone = first.groupBy("hash").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"), F.count("*").alias("keys"))
    several = alone.where("keys > 1").select("hash", "rows")
    late = (F.col("at") > F.col("first")).alias("repeated")
    clear = materialise(lookup(accepted, alone.where("keys = 1"), ["hash"], weight="rows").select("at", "hash", late), "clear")
    both = clear
    if not several.isEmpty():
        several = materialise(several, "several")
        doubtful = lookup(hashed, several, ["hash"], weight="rows").drop("rows")
        crossed = lookup(doubtful, first.join(several.select("hash"), "hash", "left_semi"), ["hash", "key"], weight="rows").select("at", "hash", late)
        both = clear.unionByName(materialise(crossed.join(accepted, ["hash", "at"], "left_semi").select("at", "hash", "repeated"), "crossed"))
    repeats = both.where("repeated").select(F.col("at").alias(order_col)).distinct()
    disproved = both.where("not repeated").select(F.col("at").alias(order_col), "hash")
    return Judged(repeats, disproved, accepted, clear, several, hashed.select("hash", "at").unionByName(known.select("hash", "at")))


def rates(found: Judged, order_col: str) -> DataFrame:
    """One row: ``keys``, ``accepted`` by filter, ``disproved`` by lookup, ``repeats``, ``missed``,
    ``false_positive_rate`` (disproved among new keys) and ``false_negative_rate`` (missed among repeats).

    ``missed`` is measured without the filter: rows that follow another of their
    hash, counted over all rows, less those that were found.  Hashes that several
    keys share are left out of that count on both sides.
    """
    counted = found.hashes.join(found.several.select("hash"), "hash", "left_anti").groupBy("hash", "at").agg(F.count("*").alias("n"))
    # The first row of each hash, and those that arrive with it, are no repeats.
    due = counted.groupBy("hash").agg((F.sum("n") - F.min_by("n", "at")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("due"))
    got = found.clear.agg(F.count_if("repeated").alias("got"))
    number = F.count_distinct(order_col)
    wrong = found.disproved.join(found.repeats, order_col, "left_anti").agg(number.alias("disproved"))
    keys = found.hashes.where(F.col("at") != _BEFORE_ALL).agg(F.count("*").alias("keys"))
    joined = keys  # one row each
    for one in (found.accepted.agg(F.count_distinct("at").alias("accepted")), wrong, found.repeats.agg(F.count("*").alias("repeats")), due, got):
        joined = joined.crossJoin(F.broadcast(one))
    missed = F.col("due") - F.col("got")
    return joined.select(
        "keys", "accepted", "disproved", "repeats", missed.alias("missed"),
        (F.col("disproved") / F.greatest(F.lit(1), F.col("keys") - F.col("repeats"))).alias("false_positive_rate"), (missed / F.greatest(F.lit(1), F.col("due"))).alias("false_negative_rate"),
    )


def verdicts(rows: DataFrame, key: Column, order_col: str, prior: DataFrame | None = None, prior_key: Column | None = None, bits_per_key: int = BITS_PER_KEY, earlier: Earlier | None = None) -> tuple[DataFrame, DataFrame]:
    """The repeats among ``rows``, and the measured errors of the filter.

    The first result has ``order_col`` of every row whose key equals that of a
    row with a smaller ``order_col`` or an earlier key; the second is ``rates``.  Null and
    empty keys are never repeats and not counted; rows that share an ``order_col``
    arrive together and are not earlier than each other; null ``order_col`` is left out.
    """
    found = judged(rows, key, order_col, prior, prior_key, bits_per_key, earlier)
    return found.repeats, rates(found, order_col)
