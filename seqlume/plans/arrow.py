"""Arrow columns as numpy arrays, and group numbers for several columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty.

    Characters beyond ASCII become one byte, 0xFF, each, so that bytes are positions.
    """
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if len(data) and data.max() > 127:
        lead = (data & 0xC0) != 0x80
        ends = np.concatenate([[0], np.cumsum(lead)])
        return np.where(data > 127, 0xFF, data).astype(np.uint8)[lead], ends[offsets]
    return data, offsets


def group_codes(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A group number for each row, and the first row of each group; null is a value."""
    code = np.zeros(rows, np.int64)
    first = np.zeros(min(rows, 1), np.int64)
    for column in columns:
        own = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first, code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_index=True, return_inverse=True)
    return code, first
