"""Stretches of sequence that several records share, by seeds and chains.

Seeds are minimizers: of the k-mers in each window of ``span`` bases the one
with the smallest hash.  Equal windows have equal seeds, so nothing is lost,
and only about one k-mer in ten is shuffled.  Seeds that two records have are
kept with the windows they stand for; each window is linked to one
representative of the same content in another record, never to all of them.
The linked matches of two records are chained in order, with a cost for gaps,
by a Fenwick tree over positions in the partner, and chains can be aligned to
passages that agree but for a few bases.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlume.plans.scratch import materialise
from seqlume.plans.skew import lookup

SPAN, SEED = 40, 20
#: Exact bases that chains of fuzzy passages are made of: seeds, at all places.
STRETCH = SEED
#: Texts that hold one seed are paired in blocks of this many.
BLOCK_TEXTS = 1_000
#: Score of a matching base is 1; each base of a gap, in either record, costs this.
GAP_COST = 0.2
#: Seeds shared between records that are broadcast at most (8 bytes each).
BROADCAST_SEEDS = 1_000_000
#: Bases handled at a time by a worker; longer sequences are cut with overlap.
CHUNK = 2_000_000
#: Bits a base of the map that tells which seeds may occur twice, and bits of a piece of it (as a power of two).
MAP_BITS, PIECE_BITS = 64, 22
_PLACE = np.uint64((1 << 24) - 1)

_CODE = np.full(256, 4, np.uint8)
for _i, _base in enumerate("ACGT"):
    _CODE[ord(_base)] = _CODE[ord(_base.lower())] = _i


def _hash(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(30)
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x moved ``by`` to the left; what falls off the end repeats the last value."""
    return np.concatenate([x[by:], np.repeat(x[-1:], by)]) if by < len(x) else np.repeat(x[-1:], len(x))


def _packed(code: np.ndarray, length: int) -> np.ndarray:
    """At each place the next ``length`` (at most 32) bases, two bits each, by doubling."""
    have, x = 1, code.astype(np.uint64)
    powers = {1: x}
    while have * 2 <= length:
        x = (x << np.uint64(2 * have)) | _shifted(x, have)
        have *= 2
        powers[have] = x
    result, done = powers[have], have
    for size in sorted(powers, reverse=True):
        while done + size <= length and done < length:
            result = (result << np.uint64(2 * size)) | _shifted(powers[size], done)
            done += size
    return result


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x, _shifted(x, have))
        have *= 2
    return np.minimum(x, _shifted(x, width - have)) if width > have else x


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over bytes: for each run of windows with one minimizer its seed, first place and
    number of windows; and the 2-bit codes (4 where it is no base)."""
    code = _CODE[data]
    n = len(code) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), code
    bad = np.concatenate([[0], np.cumsum(code > 3, dtype=np.int32)])
    good = bad[SPAN:] == bad[:-SPAN]
    kmer = _packed(code & 3, SEED)
    place = np.arange(len(code), dtype=np.uint64)
    least = _sliding_min((_hash(kmer) & ~_PLACE) | place, SPAN - SEED + 1)[:n]
    at = np.where(good, (least & _PLACE).astype(np.int64), -1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, n))
    keep = at[first] >= 0
    first, count = first[keep], count[keep]
    return _hash(kmer[at[first]]).view(np.int64), first, count, code


def seeds(records: DataFrame, id_col: str = "record", seq_col: str = "sequence") -> DataFrame:
    """``seed``, ``record``, ``start``, ``n`` (windows) and the bases they cover.

    ``head`` packs the 32 bases from ``start``, ``tail`` the 32 from ``start + 28``,
    so that up to 60 bases, which 21 windows cover, need two numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            pieces: list[tuple[int, int, bytes]] = []
            size = 0
            for row, sequence in enumerate(batch.column(1).to_pylist()):
                raw = (sequence or "").encode("ascii", "replace")
                for offset in range(0, max(1, len(raw) - SPAN + 1), CHUNK):
                    piece = raw[offset : offset + CHUNK + SPAN - 1]
                    if len(piece) >= SPAN:
                        pieces.append((row, offset, piece))
                        size += len(piece) + 1
                    if size > CHUNK:
                        yield pack(ids, pieces)
                        pieces, size = [], 0
            if pieces:
                yield pack(ids, pieces)

    def pack(ids: np.ndarray, pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"-".join(p for _, _, p in pieces) + b"-" * 64, np.uint8)
        begin = np.cumsum([0] + [len(p) + 1 for _, _, p in pieces[:-1]])
        seed, first, count, code = _runs(data)
        whole = _packed(code & 3, 32)
        owner = np.searchsorted(begin, first, "right") - 1
        rows = np.array([r for r, _, _ in pieces], np.int64)
        offset = np.array([o for _, o, _ in pieces], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(seed), pa.array(ids[rows[owner]]), pa.array((first - begin[owner] + offset[owner]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(whole[first].view(np.int64)), pa.array(whole[first + 28].view(np.int64))],
            names=["seed", "record", "start", "n", "head", "tail"],
        )

    source = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), seq_col)
    return source.mapInArrow(run, "seed long, record long, start int, n int, head long, tail long")


def _twenty(head: np.ndarray, tail: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 20 bases from base ``at`` (0 to 40) of the 60 in head (0 to 31) and tail (28 to 59)."""

    def bits(n: np.ndarray) -> np.ndarray:
        return (np.clip(n, 0, 31) * 2).astype(np.uint64)

    mask = np.uint64((1 << 40) - 1)
    across = (head << bits(at - 12)) | ((tail << np.uint64(8)) >> np.uint64(1) >> (np.uint64(63) - bits(at - 12)))
    return np.where(at <= 12, head >> bits(12 - at), np.where(at >= 28, tail >> bits(40 - at), across)) & mask


def _windows(runs: DataFrame) -> DataFrame:
    """A row for each window of a run: its 40 bases exactly, as two numbers of 20 bases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            record, start, n, head, tail = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(n):
                continue
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            head, tail = head.view(np.uint64)[row], tail.view(np.uint64)[row]
            left, right = _twenty(head, tail, at), _twenty(head, tail, at + 20)
            yield pa.RecordBatch.from_arrays(
                [pa.array(record[row]), pa.array((start[row] + at).astype(np.int32)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64))],
                names=["record", "at", "left", "right"],
            )

    return runs.select("record", "start", "n", "head", "tail").mapInArrow(run, "record long, at int, left long, right long")


def matches(records: DataFrame, id_col: str = "record", seq_col: str = "sequence") -> DataFrame:
    """Linked windows: ``record``, ``at``, ``partner``, ``there``.

    Each window whose bases another record has is linked to the first such
    window, or for windows of that first record to the last.  So links are as
    many as shared windows, however many records share them.  Records are told
    apart by ``id_col``; rows that repeat an id are one record, and what it shares
    with itself does not count.  Rows without an id, without a sequence or with
    one shorter than a window, and windows with anything but A, C, G and T (in
    either case) have no links; an empty table has none.
    """
    all_seeds = seeds(records, id_col, seq_col)
    shared = all_seeds.groupBy("seed").agg(F.min("record").alias("lo"), F.max("record").alias("hi"), F.count("*").alias("rows")).where("lo != hi").select("seed", "rows")
    shared = materialise(shared, "seeds")
    kept = lookup(all_seeds, shared, ["seed"], weight="rows", broadcast_rows=BROADCAST_SEEDS)
    windows = materialise(_windows(kept), "windows")
    place = F.struct("record", "at")
    ends = windows.groupBy("left", "right").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("rows")).where("lo.record != hi.record")
    joined = lookup(windows, materialise(ends, "ends"), ["left", "right"], weight="rows")
    other = F.when(F.col("lo.record") == F.col("record"), F.col("hi")).otherwise(F.col("lo"))
    return joined.select("record", "at", other["record"].alias("partner"), other["at"].alias("there"))


class Fenwick:
    """Largest value over the places before a place; values only grow."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def before(self, place: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while place > 0:
            if self.best[place] > found:
                found = self.best[place]
            place -= place & -place
        return found


def chain(segments: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> list[int]:
    """The chain each segment (x, y, length) belongs to.

    Segments are joined in order in both records where the score gained is more
    than the gap costs; every segment is on exactly one chain.  A gap costs its
    length in either record, so a cost splits into a part of each end, and the
    best predecessor is a prefix maximum over places in the partner.
    """
    ends = sorted({y + n for _, y, n in segments})
    rank = {e: i for i, e in enumerate(ends)}
    starts = sorted(range(len(segments)), key=lambda i: segments[i])
    closing = sorted(range(len(segments)), key=lambda i: (segments[i][0] + segments[i][2], segments[i]))
    tree, score, back = Fenwick(len(ends)), [0.0] * len(segments), [-1] * len(segments)
    done = 0
    for i in starts:
        x, y, n = segments[i]
        while done < len(closing) and segments[closing[done]][0] + segments[closing[done]][2] <= x:
            j = closing[done]
            jx, jy, jn = segments[j]
            tree.put(rank[jy + jn], (score[j] + gap_cost * (jx + jn + jy + jn), j))
            done += 1
        value, j = tree.before(bisect.bisect_right(ends, y))
        gain = value - gap_cost * (x + y)
        score[i], back[i] = (n + gain, j) if j >= 0 and gain > 0 else (float(n), -1)
    chains, taken, name = [-1] * len(segments), [False] * len(segments), 0
    for i in sorted(range(len(segments)), key=lambda i: (-score[i], segments[i])):
        if chains[i] >= 0:
            continue
        while i >= 0 and not taken[i]:
            taken[i], chains[i], i = True, name, back[i]
        name += 1
    return chains


def _by_group(rows: Callable[[dict[str, np.ndarray]], pa.RecordBatch | None], names: list[str]) -> Callable:
    """Hand whole groups (of the first column, sorted) to ``rows``, many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, limit = 0, 200_000

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count, limit
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            if cut:
                found = rows({n: table.column(n).to_numpy()[:cut] for n in names})
                if found is not None:
                    yield found
            rest = table.slice(cut)
            held, count = (rest.to_batches() if len(rest) else []), len(rest)
            limit = max(200_000, 2 * count)  # a group that is longer is put together a few times only

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count > limit:
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def chains(linked: DataFrame, gap_cost: float = GAP_COST, span: int = SPAN, keys: tuple[str, ...] = ("record", "partner")) -> DataFrame:
    """Chained segments: ``record``, ``partner``, ``chain``, ``start``, ``end``, ``there`` and ``there_end``.

    Windows of ``span`` bases that follow each other in both records make one segment.
    Rows are dealt out by ``keys``, which every pair has in common, so a record that
    shares with many others is spread.
    """

    def rows(g: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        record, partner, at, there = g["record"], g["partner"], g["at"].astype(np.int64), g["there"].astype(np.int64)
        order = np.lexsort((at, there - at, partner, record))
        record, partner, at, there = record[order], partner[order], at[order], there[order]
        step = np.diff(at)
        same = (record[1:] == record[:-1]) & (partner[1:] == partner[:-1]) & (there[1:] - at[1:] == there[:-1] - at[:-1]) & (step <= span)
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.append(first[1:], len(at)) - 1
        r, p, x, y, n = record[first], partner[first], at[first], there[first], at[last] - at[first] + span
        pair = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
        begin = np.append(np.flatnonzero(pair), len(r))
        name = np.zeros(len(r), np.int32)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            if b - a > 1:
                name[a:b] = chain(list(zip(x[a:b].tolist(), y[a:b].tolist(), n[a:b].tolist(), strict=True)), gap_cost)
        cols = [r, p, name, x.astype(np.int32), (x + n).astype(np.int32), y.astype(np.int32), (y + n).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["record", "partner", "chain", "start", "end", "there", "there_end"])

    names = ["record", "partner", "at", "there"]
    return (
        linked.select(*names).repartition(*keys).sortWithinPartitions("record")
        .mapInArrow(_by_group(rows, names), "record long, partner long, chain int, start int, end int, there int, there_end int")
    )


def shared_runs(chained: DataFrame) -> DataFrame:
    """Maximal runs of shared bases of each record: the union of its segments."""

    def rows(g: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        order = np.lexsort((g["start"], g["record"]))
        r, a, b = g["record"][order], g["start"][order].astype(np.int64), g["end"][order].astype(np.int64)
        new = np.concatenate([[True], r[1:] != r[:-1]])
        # Ends so far within a record: records are lifted apart so that one running maximum does.
        lift = np.cumsum(new).astype(np.int64) << 34
        reach = np.maximum.accumulate(b + lift)
        first = np.concatenate([[True], (a + lift)[1:] > reach[:-1]])
        at = np.flatnonzero(first)
        end = (reach - lift)[np.append(at[1:], len(r)) - 1]
        return pa.RecordBatch.from_arrays([pa.array(r[at]), pa.array(a[at].astype(np.int32)), pa.array(end.astype(np.int32))], names=["record", "start", "end"])

    names = ["record", "start", "end"]
    return chained.select(*names).repartition("record").sortWithinPartitions("record").mapInArrow(_by_group(rows, names), "record long, start int, end int")


def _edits(a: str, b: str) -> int:
    """Edit distance of two gaps, row by row in numpy."""
    if not a or not b:
        return len(a) + len(b)
    y = np.frombuffer(b.encode(), np.uint8)
    ramp = np.arange(len(b) + 1)
    row = ramp.copy()
    for i, ch in enumerate(a.encode()):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (y != ch), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row[-1])


def passages(records: DataFrame, chained: DataFrame, id_col: str = "record", seq_col: str = "sequence") -> DataFrame:
    """Chains aligned to fuzzy passages.

    ``record``, ``start``, ``end``, ``partner``, ``there``, ``there_end``, ``segments``,
    ``exact`` (bases in exact segments) and ``edits`` (in the gaps between them).
    The sequences of both records are fetched for the chains only.
    """
    seg = F.sort_array(F.collect_list(F.struct("start", "end", "there", "there_end")))
    grouped = chained.groupBy("record", "partner", "chain").agg(seg.alias("segments"))
    several, single = grouped.where(F.size("segments") > 1), grouped.where(F.size("segments") == 1)
    texts = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("record"), F.upper(seq_col).alias("sequence")).groupBy("record").agg(F.max("sequence").alias("sequence"))
    both = several.join(texts, "record").join(texts.select(F.col("record").alias("partner"), F.col("sequence").alias("other")), "partner")

    @F.pandas_udf("int")
    def edits(segments, sequence, other):  # noqa: ANN001, ANN202
        def one(parts, s, o):  # noqa: ANN001, ANN202
            total = 0
            for p, q in zip(parts[:-1], parts[1:], strict=True):
                total += _edits(s[p["end"] : q["start"]], o[p["there_end"] : q["there"]])
            return total

        import pandas as pd

        return pd.Series([one(*x) for x in zip(segments, sequence, other, strict=True)], dtype="int32")

    done = both.select("record", "partner", "segments", edits("segments", "sequence", "other").alias("edits"))
    first, last = F.col("segments")[0], F.element_at("segments", -1)
    return done.unionByName(single.select("record", "partner", "segments", F.lit(0).alias("edits"))).select(
        "record", first["start"].alias("start"), last["end"].alias("end"), "partner", first["there"].alias("there"), last["there_end"].alias("there_end"),
        F.size("segments").alias("segments"), F.aggregate("segments", F.lit(0), lambda t, s: t + s["end"] - s["start"]).alias("exact"), "edits",
    )


def _seeds_at(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of the ``STRETCH`` bases at every place of (text, offset, bases) where all are A, C, G or T."""
    code = _CODE[np.frombuffer(b"-".join(p for _, _, p in pieces) + b"-" * STRETCH, np.uint8)]
    begin = np.cumsum([0] + [len(p) + 1 for _, _, p in pieces[:-1]])
    bad = np.concatenate([[0], np.cumsum(code > 3, dtype=np.int32)])
    place = np.flatnonzero(bad[STRETCH:] == bad[:-STRETCH])
    kmer = _packed(code & 3, SEED)
    seed = _hash(kmer[place])
    if STRETCH > SEED:
        with np.errstate(over="ignore"):
            seed = _hash(seed * np.uint64(3) + kmer[place + STRETCH - SEED])
    owner = np.searchsorted(begin, place, "right") - 1
    text, offset = np.array([t for t, _, _ in pieces], np.int64), np.array([o for _, o, _ in pieces], np.int64)
    return seed, text[owner], (place - begin[owner] + offset[owner]).astype(np.int32)


def _cut(text: int, sequence: str) -> Iterator[tuple[int, int, bytes]]:
    """A sequence in pieces of ``CHUNK`` places."""
    raw = sequence.encode("ascii", "replace")
    for offset in range(0, max(1, len(raw) - STRETCH + 1), CHUNK):
        yield text, offset, raw[offset : offset + CHUNK + STRETCH - 1]


def _pack(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted numbers as compressed differences, and the bytes of each before compression."""
    steps = np.diff(values, prepend=0).astype("<u4")
    width = 1 + int(np.searchsorted([1 << 8, 1 << 16, 1 << 24], steps.max(), "right"))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4)[:, :width].T)  # bytes of one rank together
    return width, pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(n: int, width: int, packed: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    steps = np.zeros((n, 4), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view("<u4").ravel().astype(np.int64))


def repeated_places(texts: DataFrame) -> DataFrame:
    """``seed``, ``text`` and ``at`` of every place whose ``STRETCH`` bases occur at another place too, and of a few others.

    ``texts`` has ``text``, ``sequence`` and ``chunk``, which tells the texts of some
    ``CHUNK`` bases.  Seeds are marks in a map of ``MAP_BITS`` a base, cut into pieces.
    A chunk sends its marks to the pieces as compressed differences, some 1.5 bytes
    a base; a piece answers each chunk which of them were marked twice; and only
    places of such marks become rows.  About one in ``MAP_BITS`` of the others does.
    """
    bases = texts.agg(F.sum(F.length("sequence"))).first()[0] or 0
    pieces = max(1, -(-bases * MAP_BITS >> PIECE_BITS))
    size = np.uint64(pieces << PIECE_BITS)

    def marks(seed: np.ndarray) -> np.ndarray:
        return (seed % size).view(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        own, count = None, 0

        def out(chunk: int) -> pa.RecordBatch:
            found = np.sort(marks(_seeds_at(held)[0]))
            third = np.concatenate([np.zeros(2, bool), found[2:] == found[:-2]])[: len(found)] if len(found) > 2 else np.zeros(len(found), bool)
            found = found[~third]  # twice is enough
            cuts = np.flatnonzero(np.diff(found >> PIECE_BITS, prepend=-1))
            rows = []
            for a, b in zip(cuts, np.append(cuts[1:], len(found)), strict=True):
                width, packed = _pack(found[a:b] & ((1 << PIECE_BITS) - 1))
                rows.append((int(found[a] >> PIECE_BITS), chunk, int(b - a), width, packed))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["piece", "chunk", "n", "width", "packed"])

        for batch in batches:
            for chunk, text, sequence in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for piece in _cut(text, sequence):
                    if held and (chunk != own or count + len(piece[2]) > 2 * CHUNK):
                        yield out(own)
                        held, count = [], 0
                    held.append(piece)
                    own, count = chunk, count + len(piece[2])
        if held:
            yield out(own)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []

        def out() -> pa.RecordBatch:
            found = [_unpack(n, width, packed) for _, _, n, width, packed in held]
            twice = np.bincount(np.concatenate(found), minlength=1 << PIECE_BITS) > 1
            rows = []
            for (piece, chunk, *_), own in zip(held, found, strict=True):
                kept = np.unique(own[twice[own]])
                if len(kept):
                    rows.append((chunk, piece, len(kept), *_pack(kept)))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["chunk", "piece", "n", "width", "packed"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and row[0] != held[0][0]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, answers, wanted, held, count = None, [], None, [], 0

        def out() -> pa.RecordBatch:
            seed, text, at = _seeds_at(held)
            mark = marks(seed)
            keep = wanted[np.minimum(np.searchsorted(wanted, mark), len(wanted) - 1)] == mark
            return pa.RecordBatch.from_arrays([pa.array(seed[keep].view(np.int64)), pa.array(text[keep]), pa.array(at[keep])], names=["seed", "text", "at"])

        for batch in batches:
            for chunk, piece, n, width, packed, text, sequence in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if chunk != own:
                    if held:
                        yield out()
                    own, answers, wanted, held, count = chunk, [], None, [], 0
                if text is None:
                    answers.append((np.int64(piece) << PIECE_BITS) | _unpack(n, width, packed))
                    continue
                if wanted is None:
                    wanted = np.unique(np.concatenate(answers)) if answers else np.empty(0, np.int64)
                for part in _cut(text, sequence) if len(wanted) else ():
                    if held and count + len(part[2]) > CHUNK:
                        yield out()
                        held, count = [], 0
                    held.append(part)
                    count += len(part[2])
        if held:
            yield out()

    blob = "n int, width int, packed binary"
    sent = texts.select("chunk", "text", "sequence").mapInArrow(send, f"piece int, chunk long, {blob}")
    answered = sent.repartition("piece").sortWithinPartitions("piece").mapInArrow(answer, f"chunk long, piece int, {blob}")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("text", "long"), ("sequence", "string"))]
    asked = texts.select("chunk", F.lit(None).cast("int").alias("piece"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("binary").alias("packed"), "text", "sequence")
    both = answered.select("*", *none).unionByName(asked).repartition("chunk").sortWithinPartitions("chunk", F.col("text").asc_nulls_first())
    return both.mapInArrow(places, "seed long, text long, at int")


def _clusters(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """Parts of texts no chain can leave: ``text``, ``start`` and ``sequence``.

    A chain crosses a gap only if it gained more than the gap costs, and it has
    gained no more than the shared bases before the gap.  So a gap that costs as
    much as all of those ends a part, whatever the partner is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, str]] = []
            for text, sequence, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = np.unique(np.array(places, np.int64))
                covered = np.append(0, np.cumsum(np.minimum(np.diff(at), STRETCH))) + STRETCH  # up to and with each place
                wide = np.flatnonzero(np.diff(at) > STRETCH)
                first = 0
                for i in wide.tolist():
                    before = covered[i] - covered[first] + STRETCH
                    if (at[i + 1] - at[i] - STRETCH) * GAP_COST >= before:
                        rows.append((text, int(at[first]), sequence[at[first] : at[i] + STRETCH]))
                        first = i + 1
                rows.append((text, int(at[first]), sequence[at[first] : at[-1] + STRETCH]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["text", "start", "sequence"])

    joined = texts.select("text", "sequence").join(kept.groupBy("text").agg(F.collect_list("at").alias("places")), "text")
    return joined.select("text", "sequence", "places").mapInArrow(run, "text long, start int, sequence string")


def _numbered(texts: DataFrame, label: str) -> DataFrame:
    """Written with a number in ``text``, fixed by the files, and that of its ``chunk`` of some ``CHUNK`` bases."""
    texts = materialise(texts, label).withColumn("text", F.monotonically_increasing_id())
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, bases = None, 0
        for batch in batches:
            chunks = []
            for text, size in zip(batch.column(names.index("text")).to_pylist(), pc.binary_length(batch.column(names.index("sequence"))).to_pylist(), strict=True):
                if chunk is None or bases + size > CHUNK:
                    chunk, bases = text, 0
                bases += size
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int64())], names=[*names, "chunk"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields)
    return materialise(texts.mapInArrow(run, f"{schema}, chunk long"), label)


def _paired(classes: DataFrame) -> DataFrame:
    """Every two different texts that share a seed, smaller number first: ``record``, ``at``, ``partner`` and ``there``."""
    places = materialise(repeated_places(classes), "places")
    shared = places.groupBy("seed").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.count_distinct("text").alias("texts"), F.count("*").alias("rows")).where("lo != hi")
    kept = lookup(places, materialise(shared.select("seed", "texts", "rows"), "shared"), ["seed"], weight="rows")
    # Texts of a hot seed are dealt out to blocks, and each block meets every other.
    blocks = F.ceil(F.col("texts") / BLOCK_TEXTS).cast("int")
    left = kept.select("seed", F.col("text").alias("record"), "at", F.pmod(F.xxhash64("text"), blocks).cast("int").alias("block"))
    right = kept.select("seed", F.col("text").alias("partner"), F.col("at").alias("there"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return left.join(right, ["seed", "block"]).where("record < partner").select("record", "at", "partner", "there")


def fuzzy_passages(records: DataFrame, id_col: str = "record", seq_col: str = "sequence") -> DataFrame:
    """Passages of any two different texts that share a stretch of bases, as ``passages`` gives them.

    Records of one text, and parts of records with one text, stand for each other:
    passages are found between every two different texts, in either direction,
    and named by one holder of each (the smallest that is another record); every
    other holder has a row that links its whole part to that holder, so the passages of
    all records follow from the rows.  Sequences are compared without case; rows
    without an id or a sequence have no passages, and what a record shares with
    itself does not count.
    """
    held = records.where(F.col(id_col).isNotNull() & F.col(seq_col).isNotNull()).select(F.col(id_col).cast("long").alias("record"), F.upper(seq_col).alias("sequence")).distinct()
    held = held.where(F.col("sequence").rlike(f"[ACGT]{{{STRETCH}}}"))
    texts = _numbered(held.groupBy("sequence").agg(F.min("record").alias("lo"), F.max("record").alias("hi")), "texts")
    places = materialise(repeated_places(texts), "places")
    # Seeds that only repeat within a text stay in; they make a part longer, and no pair.
    shared = places.groupBy("seed").agg(F.count("*").alias("rows")).where("rows > 1")
    kept = lookup(places, materialise(shared, "seeds"), ["seed"], weight="rows", broadcast_rows=BROADCAST_SEEDS).select("text", "at")
    parts = materialise(_clusters(texts, kept).join(texts.select("text", "lo", "hi"), "text"), "parts")
    classes = _numbered(parts.groupBy("sequence").agg(F.min(F.struct(F.col("lo").alias("record"), "start")).alias("lo"), F.max(F.struct(F.col("hi").alias("record"), "start")).alias("hi")), "classes")

    chained = materialise(chains(_paired(classes), span=STRETCH), "chains")
    found = passages(classes, chained, "text")
    a, b = (classes.select(F.col("text").alias(k), F.col("lo").alias(f"{k}_lo"), F.col("hi").alias(f"{k}_hi")) for k in ("record", "partner"))
    here = F.when(F.col("record_lo.record") != F.col("partner_lo.record"), F.struct(F.col("record_lo").alias("a"), F.col("partner_lo").alias("b"))).when(
        F.col("record_hi.record") != F.col("partner_lo.record"), F.struct(F.col("record_hi").alias("a"), F.col("partner_lo").alias("b"))
    ).when(F.col("record_lo.record") != F.col("partner_hi.record"), F.struct(F.col("record_lo").alias("a"), F.col("partner_hi").alias("b")))
    named = found.join(a, "record").join(b, "partner").withColumn("h", here).where("h is not null").select(
        F.col("h.a.record").alias("record"), (F.col("start") + F.col("h.a.start")).alias("start"), (F.col("end") + F.col("h.a.start")).alias("end"),
        F.col("h.b.record").alias("partner"), (F.col("there") + F.col("h.b.start")).alias("there"), (F.col("there_end") + F.col("h.b.start")).alias("there_end"), "segments", "exact", "edits",
    )
    named = materialise(named, "named")
    turned = named.select(*[F.col(x).alias(y) for x, y in zip(("partner", "there", "there_end", "record", "start", "end"), ("record", "start", "end", "partner", "there", "there_end"), strict=True)], "segments", "exact", "edits")

    def links(members: DataFrame) -> DataFrame:
        """Each holder (``record``, ``start``) of a ``sequence`` to the first of them (``lo``), or the first to the last (``hi``)."""
        other = F.when(F.col("lo.record") == F.col("record"), F.col("hi")).otherwise(F.col("lo"))
        size = F.length("sequence")
        return members.withColumn("o", other).where("o.record != record").select(
            "record", "start", (F.col("start") + size).alias("end"), F.col("o.record").alias("partner"), F.col("o.start").alias("there"), (F.col("o.start") + size).alias("there_end"), F.lit(1).alias("segments"), size.alias("exact"), F.lit(0).alias("edits")
        )

    whole = F.lit(0).alias("start")
    copies = held.join(texts.where("lo != hi"), "sequence").select("record", whole, "sequence", F.struct(F.col("lo").alias("record"), whole).alias("lo"), F.struct(F.col("hi").alias("record"), whole).alias("hi"))
    holders = parts.select(F.col("lo").alias("record"), "start", "sequence").join(classes.select("sequence", "lo", "hi"), "sequence")
    return named.unionByName(turned).unionByName(links(copies)).unionByName(links(holders)).distinct()
