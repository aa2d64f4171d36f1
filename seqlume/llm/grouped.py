"""Mergeable summaries of many groups at once, for several sets of grouping columns.

A summary is a bag of items, numpy arrays of equal length.  ``merge`` brings the
items of all groups of a batch into their least form in one vectorised call, so
there is no Python loop over groups.  Partial summaries leave each task merged;
they are summed over a salt first and then whole, so a group that holds a third
of all rows arrives in a few small pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``merge(group, items)`` -> the same, sorted by group, in least form.
Merge = Callable[[np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, dict[str, np.ndarray]]]
#: Items a worker holds before it merges them.
HELD_ITEMS = 1_000_000
SALTS = 16

_ARROW = {"int": pa.int32(), "double": pa.float64(), "long": pa.int64()}


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A group number for each row, and the first row of each group."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        own = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = code * (int(own.max(initial=0)) + 1) + own
        # Keep numbers small, so that products of many columns do not overflow.
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _single(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def _merged(table: pa.Table, keys: list[str], fields: dict[str, str], merge: Merge) -> pa.Table:
    """One row for each group of ``keys``, with its items merged."""
    if not table.num_rows:
        return table
    group, first = _codes([_single(table.column(k)) for k in keys])
    lists = {f: _single(table.column(f)) for f in fields}
    lengths = pc.list_value_length(next(iter(lists.values()))).to_numpy(zero_copy_only=False)
    items = {f: a.flatten().to_numpy(zero_copy_only=False) for f, a in lists.items()}
    owner, items = merge(np.repeat(group, lengths), items)
    ends = np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)
    rows = pa.array(first)
    out = [table.column(k).take(rows) for k in keys]
    out += [pa.ListArray.from_arrays(pa.array(ends), pa.array(items[f], _ARROW[t])) for f, t in fields.items()]
    return pa.table(out, names=[*keys, *fields])


def summarise(
    rows: DataFrame, keys: list[str], sets: list[list[str]], values: list[str], fields: dict[str, str], lift: Callable[..., dict[str, np.ndarray]], merge: Merge, lossless: bool = False
) -> DataFrame:
    """A summary for each group of each set of columns.

    ``keys`` are the columns sets are made of, ``values`` those ``lift`` turns into
    one item a row.  The result has ``grouping`` (the names of the set, joined by
    commas), ``keys`` (null where the set has not the column) and the ``fields``.  If
    merging is ``lossless``, a set's summaries are merged from those of the smallest
    set that contains it, and only the finest are lifted from rows.
    """
    order = sorted(sets, key=len, reverse=True) if lossless else sets
    kinds = {k: rows.schema[k].dataType.simpleString() for k in keys}
    types = {f: f"array<{t}>" for f, t in fields.items()}
    schema = ", ".join(f"`{n}` {t}" for n, t in ({"grouping": "string"} | kinds | types).items())
    names = ["grouping", *keys]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            n = table.num_rows
            if not n:
                continue
            items = lift(*[_single(table.column(v)) for v in values])
            one = pa.array(np.arange(n + 1, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(one, pa.array(items[f], _ARROW[t])) for f, t in fields.items()]
            base = pa.table([*(table.column(k) for k in keys), *lists], names=[*keys, *fields])
            made: list[tuple[set[str], pa.Table]] = []
            for chosen in order:
                source = min((t for have, t in made if have >= set(chosen)), key=len, default=base) if lossless else base
                size = source.num_rows
                columns = [pa.array([",".join(chosen)]).take(pa.array(np.zeros(size, np.int32)))]
                columns += [source.column(k) if k in chosen else pa.nulls(size, source.column(k).type) for k in keys]
                held.append(_merged(pa.table([*columns, *(source.column(f) for f in fields)], names=[*names, *fields]), names, fields, merge))
                made.append((set(chosen), held[-1]))
                count += held[-1].num_rows * 4
            if count > HELD_ITEMS:
                whole = _merged(pa.concat_tables(held), names, fields, merge)
                # Groups that come once or twice gain nothing by waiting.
                yield from whole.to_batches(max_chunksize=50_000)
                held, count = [], 0
        if held:
            yield from _merged(pa.concat_tables(held), names, fields, merge).to_batches(max_chunksize=50_000)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, HELD_ITEMS
        for batch in batches:
            held.append(batch)
            size += sum(_single(batch.column(f)).flatten().__len__() for f in fields)
            if size > limit:
                whole = _merged(pa.Table.from_batches(held), names, fields, merge)
                held = whole.combine_chunks().to_batches()
                size = sum(len(b.column(f).flatten()) for b in held for f in fields)
                limit = max(HELD_ITEMS, 2 * size)
        if held:
            yield from _merged(pa.Table.from_batches(held), names, fields, merge).to_batches(max_chunksize=50_000)

    parts = rows.select(*keys, *values).mapInArrow(partial, schema)
    # Only sets of few groups gain by a salt; it costs them one small shuffle more.
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.repartition("_salt", *names).drop("_salt").mapInArrow(final, schema)
    return some.repartition(*names).mapInArrow(final, schema)


def merge_summaries(parts: DataFrame, keys: list[str], fields: dict[str, str], merge: Merge) -> DataFrame:
    """Combine stored summaries, say of several days, by ``keys``."""
    kinds = {k: parts.schema[k].dataType.simpleString() for k in keys} | {f: f"array<{t}>" for f, t in fields.items()}
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items())

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Groups come one after the other: what is merged but for the last group is done.
        held, items = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            items += sum(len(_single(batch.column(f)).flatten()) for f in fields)
            if items > HELD_ITEMS:
                held = _merged(held, [tag, *keys], fields, merge)
                last = held.column(tag)[held.num_rows - 1]
                done = held.filter(pc.not_equal(held.column(tag), last))
                held = held.filter(pc.equal(held.column(tag), last))
                yield from done.drop_columns([tag]).to_batches(max_chunksize=50_000)
                items = sum(len(_single(held.column(f)).flatten()) for f in fields)
        if held is not None:
            yield from _merged(held, [tag, *keys], fields, merge).drop_columns([tag]).to_batches(max_chunksize=50_000)

    tag = "_group"  # groups in order, nulls included
    tagged = parts.select(F.xxhash64(*keys).alias(tag) if keys else F.lit(0).cast("long").alias(tag), *keys, *fields)
    return tagged.repartition(*(keys or [tag])).sortWithinPartitions(tag).mapInArrow(final, schema)
