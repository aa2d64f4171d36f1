"""Public hash functions over whole columns, for parity with stores that keep hashes.

Everything else in the library groups by the keys themselves or by xxhash64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlume.plans.arrow import text_bytes

#: The multipliers and additions of MurmurHash3 for 64-bit machines.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_ADD1, _ADD2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _avalanche(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def murmur3(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The second half of MurmurHash3 x64 128 for each text, texts of one length at a time.

    Padding with zeros makes the last words those of the algorithm's tail: a
    word of zeros mixes to zero and changes nothing.
    """
    lengths = np.diff(offsets)
    result = np.zeros(len(lengths), np.uint64)
    with np.errstate(over="ignore"):
        for size in np.unique(lengths):
            rows = np.flatnonzero(lengths == size)
            padded = np.zeros((len(rows), (int(size) // 16 + 1) * 16), np.uint8)
            padded[:, :size] = data[offsets[rows][:, None] + np.arange(size)]
            words = padded.view("<u8").astype(np.uint64)
            a = seeds[rows].astype(np.uint64)
            b = a.copy()
            for i in range(words.shape[1] // 2):
                first, second = words[:, 2 * i] * _C1, words[:, 2 * i + 1] * _C2
                a ^= _rotate(first, 31) * _C2
                if i < size // 16:
                    a = (_rotate(a, 27) + b) * np.uint64(5) + _ADD1
                b ^= _rotate(second, 33) * _C1
                if i < size // 16:
                    b = (_rotate(b, 31) + a) * np.uint64(5) + _ADD2
            a, b = a ^ np.uint64(size), b ^ np.uint64(size)
            a = a + b
            b = b + a
            a, b = _avalanche(a), _avalanche(b)
            result[rows] = b + (a + b)
    return result


@F.arrow_udf(T.LongType())
def murmur3_64(text: pa.Array, seed: pa.Array) -> pa.Array:
    """``murmur3`` of a text column and a column of seeds; the sign bit is part of the hash."""
    data, offsets = text_bytes(text)
    return pa.array(murmur3(data, offsets, seed.to_numpy(zero_copy_only=False).astype(np.int64)).view(np.int64))


def wang(x: np.ndarray) -> np.ndarray:
    """Thomas Wang's mix of 64-bit numbers: steps that each can be undone."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = x * np.uint64((1 << 21) - 1) - np.uint64(1)
        x ^= x >> np.uint64(24)
        x = x * np.uint64(265)
        x ^= x >> np.uint64(14)
        x = x * np.uint64(21)
        x ^= x >> np.uint64(28)
        return x * np.uint64(1 + (1 << 31))


def unwang(x: np.ndarray) -> np.ndarray:
    """The number whose ``wang`` is x: inverse factors, and shifts undone from the top."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = x * np.uint64(pow(1 + (1 << 31), -1, 1 << 64))
        for by, factor in ((28, 21), (14, 265), (24, (1 << 21) - 1)):
            y = x
            for _ in range(64 // by):
                y = x ^ (y >> np.uint64(by))
            x = (y + np.uint64(by == 24)) * np.uint64(pow(factor, -1, 1 << 64))
        return x
