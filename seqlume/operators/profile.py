"""Counts of bases and scores by position, and what follows from them.

One pass turns each Arrow batch into count matrices with numpy, so no row per
base ever exists; a task emits as many rows as there are positions and codes,
and these are summed.  Positions are 0-based.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlume.functions.columns import ERROR_UNIT, ERRORS
from seqlume.plans.arrow import group_codes, text_bytes
from seqlume.plans.bins import bin_index, bins_for
from seqlume.plans.scratch import materialise

END = 100
BASES = "ACGTN"
#: The names of the twelve score bins.
PHRED_LABELS = ["0-3", "4-7", "8-11", "12-15", "16-19", "20-23", "24-27", "28-31", "32-35", "36-39", "40-43", ">=44"]
#: Mean error of the four scores of each bin.
BIN_ERRORS = [sum(10 ** (-(4 * i + j) / 10) for j in range(4)) / 4 for i in range(12)]
SERIES = [1, 5, 10, 25, 50, 75, 90, 95, 99]

_BASE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _BASE[ord(_b)] = _BASE[ord(_b.lower())] = _i
_SCORE_BIN = np.array([min(max(c - 33, 0), 47) >> 2 for c in range(256)], np.uint8)
_IS_SCORE = np.array([33 <= c <= 126 for c in range(256)])
#: Bases handled at a time, and counts held before they leave a worker.
CHUNK, HELD = 4_000_000, 4_000_000


def usable_scores(sequence: Column, qualities: Column) -> Column:
    """Qualities as long as the sequence and within range, else null."""
    return F.when((F.length(sequence) == F.length(qualities)) & ~qualities.rlike(r"[^\x21-\x7E]"), qualities)


def _sums(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums."""
    if n is None and len(keys) and keys.max() < 8 * len(keys) + 1_000_000:
        counts = np.bincount(keys)
        found = np.flatnonzero(counts)
        return found, counts[found]
    found, inverse = np.unique(keys, return_inverse=True)
    if n is None:
        return found, np.bincount(inverse, minlength=len(found))
    total = np.zeros(len(found), np.int64)
    np.add.at(total, inverse, n)
    return found, total


def profile(reads: DataFrame, by: list[str] | None = None, end: int = END) -> DataFrame:
    """``kind`` (base, phred, end_base, end_phred), ``by``, ``pos``, ``code``, ``n``.

    Codes are places in ``BASES`` or ``PHRED_LABELS``.  The end kinds align
    reads at their last base: position ``end - 1`` is the last.  Null and empty
    sequences count nowhere; qualities that are missing, of another length or
    out of range are left out of the phred kinds only.
    """
    by = by or []
    kinds = {b: reads.schema[b].dataType.simpleString() for b in by}
    schema = ", ".join(f"`{n}` {t}" for n, t in ({"kind": "int"} | kinds | {"pos": "int", "code": "int", "n": "long"}).items())

    def count(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, codes: np.ndarray, kind: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        total = int(lengths.sum())
        if not total:
            return []
        pos = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        where = np.repeat(starts, lengths) + pos
        code = codes[data[where]].astype(np.int64)
        owner = np.repeat(group, lengths)
        width = int(lengths.max())
        keys, n = _sums((owner * width + pos) * 16 + code)
        found = [(kind, (keys // 16 // width << 36) | (keys // 16 % width << 4) | keys % 16, n)]
        near = pos >= np.repeat(lengths - end, lengths)
        slot = (pos - np.repeat(lengths, lengths) + end)[near]
        keys, n = _sums((owner[near] * end + slot) * 16 + code[near])
        found.append((kind + 2, (keys // 16 // end << 36) | (keys // 16 % end << 4) | keys % 16, n))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in range(4)}
        names: dict[tuple, int] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            labels = list(names)
            for kind, parts in held.items():
                if not parts:
                    continue
                keys, n = _sums(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
                parts.clear()
                rows = (keys >> 36).tolist()
                columns = [pa.array(np.full(len(keys), kind, np.int32))]
                columns += [pa.array([labels[r][i] for r in rows], batch_types[i]) for i in range(len(by))]
                columns += [pa.array(((keys >> 4) & 0xFFFFFFFF).astype(np.int32)), pa.array((keys & 15).astype(np.int32)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", *by, "pos", "code", "n"])

        batch_types: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i) for i in range(len(by))]
            batch_types = [k.type for k in keys]
            code, first = group_codes(keys, batch.num_rows)
            labels = list(zip(*[k.take(pa.array(first)).to_pylist() for k in keys], strict=True)) if by else [()]
            group = np.array([names.setdefault(label, len(names)) for label in labels], np.int64)[code]
            for column, codes, kind in ((len(by), _BASE, 0), (len(by) + 1, _SCORE_BIN, 1)):
                data, offsets = text_bytes(batch.column(column))
                cuts = [0]
                while cuts[-1] < batch.num_rows:
                    stop = int(np.searchsorted(offsets, offsets[cuts[-1]] + CHUNK, "right")) - 1
                    cuts.append(min(batch.num_rows, max(stop, cuts[-1] + 1)))
                for a, b in zip(cuts, cuts[1:], strict=False):
                    for k, where, n in count(data, offsets[a:b], offsets[a + 1 : b + 1] - offsets[a:b], group[a:b], codes, kind):
                        held[k].append((where, n))
                        size += len(n)
            if size > HELD:
                for k in held:
                    if held[k]:
                        held[k] = [_sums(np.concatenate([x for x, _ in held[k]]), np.concatenate([c for _, c in held[k]]))]
                size = sum(len(n) for parts in held.values() for _, n in parts)
                if size > HELD // 2:
                    yield from out()
                    size = 0
        yield from out()

    source = reads.select(*by, "sequence", usable_scores(F.col("sequence"), F.col("qualities")).alias("qualities"))
    names = F.array(*[F.lit(k) for k in ("base", "phred", "end_base", "end_phred")])
    return source.mapInArrow(run, schema).groupBy("kind", *by, "pos", "code").agg(F.sum("n").alias("n")).withColumn("kind", names[F.col("kind")])


def labelled(profiled: DataFrame, kind: str, by: list[str]) -> DataFrame:
    """Counts of one kind with the names of their codes."""
    names = list(BASES) if kind.endswith("base") else PHRED_LABELS
    what = "base" if kind.endswith("base") else "phred"
    return profiled.where(F.col("kind") == kind).select(*by, "pos", F.array(*[F.lit(x) for x in names])[F.col("code")].alias(what), "n")


def longest_read(positions: DataFrame) -> int:
    """The number of positions that occur, 0 for none."""
    last = positions.agg(F.max("pos")).first()[0]
    return 0 if last is None else last + 1


def binned(profiled: DataFrame, kind: str, by: list[str], longest: int | None = None) -> DataFrame:
    """``by``, ``bin``, ``code``, ``n``: positions brought together for reads up to ``longest``."""
    if longest is None:  # the counts are read twice, the reads once
        profiled = materialise(profiled, "profile")
        longest = longest_read(profiled.where(F.col("kind") == kind))
    part = profiled.where(F.col("kind") == kind)
    stops = [stop for _, stop in bins_for(longest)] if longest else [1]
    return part.groupBy(*by, bin_index(F.col("pos"), stops).alias("bin"), "code").agg(F.sum("n").alias("n"))


def fractions(counts: DataFrame, by: list[str], place: str = "bin") -> DataFrame:
    """Share of each code at its place."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by, place))
    return counts.withColumn("fraction", F.round(share, 6))


def base_content(counts: DataFrame, by: list[str], place: str = "bin") -> DataFrame:
    """Share of each known base at its place, N left out."""
    return fractions(counts.where("code < 4"), by, place)


def n_content(counts: DataFrame, by: list[str], place: str = "bin") -> DataFrame:
    """Share of unknown bases at each place."""
    return counts.groupBy(*by, place).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("code") == 4, F.col("n")).otherwise(0)).alias("unknown")).select(
        *by, place, "unknown", "total", F.round(F.col("unknown") / F.col("total"), 6).alias("fraction")
    )


def quality_spread(counts: DataFrame, by: list[str]) -> DataFrame:
    """Mean score of the worst and the best bases at each place: ``bin``, ``series``, ``phred``.

    For a share p the worst floor(p * total) bases are the bottom, the others
    the top; both are 0 where that number is 0.  Series: ``mean``, ``bottom 1`` ...
    ``bottom 50`` and ``top 50`` ... ``top 1``.
    """
    order = Window.partitionBy(*by, "bin").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, "bin")
    error = F.element_at(F.array(*[F.lit(e) for e in BIN_ERRORS]), F.col("code") + 1)
    base = counts.select(*by, "bin", "code", "n", error.alias("e")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("total", F.sum("n").over(whole))
    sums = [F.sum(F.col("n") * F.col("e")).alias("all"), F.first("total").alias("total")]
    for p in SERIES:
        cut = F.floor(F.col("total") * F.lit(p / 100))
        sums.append(F.sum(F.least(F.greatest(cut - F.col("before"), F.lit(0)), F.col("n")) * F.col("e")).alias(f"w{p}"))
    summed = base.groupBy(*by, "bin").agg(*sums)

    def scored(error: Column, n: Column) -> Column:
        return F.round(-10 * F.log10(error / n), 4)

    rows = [F.struct(F.lit("mean").alias("series"), scored(F.col("all"), F.col("total")).alias("phred"))]
    for p in SERIES:
        cut = F.floor(F.col("total") * F.lit(p / 100))
        if p <= 50:
            rows.append(F.struct(F.lit(f"bottom {p}").alias("series"), F.when(cut > 0, scored(F.col(f"w{p}"), cut)).otherwise(0.0).alias("phred")))
        if p >= 50:
            rows.append(F.struct(F.lit(f"top {100 - p}").alias("series"), F.when(cut > 0, scored(F.col("all") - F.col(f"w{p}"), F.col("total") - cut)).otherwise(0.0).alias("phred")))
    return summed.select(*by, "bin", F.inline(F.array(*rows)))


def tile_errors(reads: DataFrame, tile: Column, by: list[str] | None = None) -> DataFrame:
    """``by``, ``tile``, ``pos``, ``error`` (sum, in units of 10^-9) and ``n``, for reads with a tile and scores."""
    by = by or []
    kinds = {b: reads.schema[b].dataType.simpleString() for b in by} | {"tile": "long"}
    schema = ", ".join(f"`{n}` {t}" for n, t in (kinds | {"pos": "int", "error": "long", "n": "long"}).items())
    # Whole units of 10^-9 add up exactly in doubles up to 9 million reads a batch.
    table = np.zeros(256)
    for q, e in enumerate(ERRORS):
        table[q + 33] = round(e / (ERROR_UNIT / 1e9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i) for i in range(len(by) + 1)]
            code, first = group_codes(keys, batch.num_rows)
            data, offsets = text_bytes(batch.column(len(by) + 1))
            lengths = np.diff(offsets)
            if not len(data):
                continue
            pos = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
            width = int(lengths.max())
            key, inverse = np.unique(np.repeat(code, lengths) * width + pos, return_inverse=True)
            errors = np.bincount(inverse, table[data]).astype(np.int64)
            rows = pa.array(first[key // width])
            columns = [k.take(rows) for k in keys] + [pa.array((key % width).astype(np.int32)), pa.array(errors), pa.array(np.bincount(inverse).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "tile", "pos", "error", "n"])

    scored = reads.select(*by, tile.alias("tile"), usable_scores(F.col("sequence"), F.col("qualities")).alias("qualities")).where("tile is not null and qualities is not null")
    return scored.mapInArrow(run, schema).groupBy(*by, "tile", "pos").agg(F.sum("error").alias("error"), F.sum("n").alias("n"))


def tile_deviation(errors: DataFrame, by: list[str], longest: int | None = None) -> DataFrame:
    """Mean score of each tile and bin less the mean over all tiles: ``deviation``."""
    if longest is None:
        errors = materialise(errors, "errors")
        longest = longest_read(errors)
    stops = [stop for _, stop in bins_for(longest)] if longest else [1]
    mean = F.sum("error") / 1e9 / F.greatest(F.sum("n"), F.lit(1))
    summed = errors.groupBy(*by, "tile", bin_index(F.col("pos"), stops).alias("bin")).agg(mean.alias("mean"))
    # Tiles without reads as long as a bin have the score 0 there.
    tiles, places = summed.select(*by, "tile").distinct(), F.explode(F.sequence(F.lit(0), F.lit(len(stops) - 1))).alias("bin")
    full = tiles.select("*", places).join(summed, [*by, "tile", "bin"], "left")
    score = F.when(F.coalesce("mean", F.lit(0.0)) > 0, -10 * F.log10("mean")).otherwise(0.0)
    scored = full.select(*by, "tile", "bin", score.alias("score"))
    return scored.withColumn("deviation", F.round(F.col("score") - F.avg("score").over(Window.partitionBy(*by, "bin")), 4)).withColumn("score", F.round("score", 4))


def flagged_tiles(deviations: DataFrame, by: list[str]) -> DataFrame:
    """Tiles whose lowest deviation is -3 or less (2x errors) or -10 or less (10x errors)."""
    lowest = deviations.groupBy(*by, "tile").agg(F.min("deviation").alias("lowest"))
    flag = F.when(F.col("lowest") <= -10, "10x").when(F.col("lowest") <= -3, "2x")
    return lowest.withColumn("errors", flag).where("errors is not null")
