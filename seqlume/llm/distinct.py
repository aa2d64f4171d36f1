"""Distinct counts by registers with indicator bits and maximum likelihood.

A register keeps the largest rank of the values hashed to it and, in
``BITS`` indicator bits, which of the next lower ranks occurred too.  Ranks
have a base of 2^(1/2) (``FINE`` = 1), so a register takes 16 bits.  Registers
merge without loss, and the maximum likelihood estimate has a relative standard
error of sqrt(0.244 / m) with m registers: as good as a register array of six
bits that is some 40 % larger.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.llm.grouped import merge_summaries, summarise

PRECISION = 12
FINE, BITS = 1, 9
#: Items: register number and state, rank x 2^BITS + indicator bits.
FIELDS = {"registers": "int", "states": "int"}


def standard_error(precision: int = PRECISION) -> float:
    """Relative standard error (3.90 bits of memory-variance product over 16-bit registers)."""
    return math.sqrt(3.90 / 16 / 2**precision)


def _level(rank: np.ndarray, precision: int) -> np.ndarray:
    """A rank has probability 2^-level within its register."""
    return np.minimum(FINE + 1 + (rank - 1) // (1 << FINE), 64 - precision)


def lift(hashes: pa.Array, precision: int = PRECISION) -> dict[str, np.ndarray]:
    """The register and state that one value alone gives."""
    h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
    register = (h >> np.uint64(64 - precision)).astype(np.int32)
    low = (h & np.uint64((1 << FINE) - 1)).astype(np.int64)
    middle = (h << np.uint64(precision)) >> np.uint64(precision + FINE) << np.uint64(FINE)
    width = 64 - precision - FINE
    # Leading zeros of the middle bits, exactly: frexp would round 53 bits or more.
    value = middle >> np.uint64(FINE)
    high = (value >> np.uint64(26)).astype(np.float64)
    _, e_high = np.frexp(high)
    _, e_low = np.frexp((value & np.uint64((1 << 26) - 1)).astype(np.float64))
    zeros = width - np.where(high > 0, e_high + 26, e_low)
    rank = zeros.astype(np.int64) * (1 << FINE) + low + 1
    return {"registers": register, "states": (rank << BITS).astype(np.int32)}


def merge(group: np.ndarray, items: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Equal registers of a group become one: the largest rank, and all bits seen below it."""
    register, state = items["registers"].astype(np.int64), items["states"].astype(np.int64)
    key = (group.astype(np.int64) << 20) | register
    order = np.argsort(key, kind="stable")
    key, state = key[order], state[order]
    if not len(key):
        return group, {"registers": items["registers"], "states": items["states"]}
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    rank = state >> BITS
    top = np.maximum.reduceat(rank, first)
    lag = np.minimum(np.repeat(top, np.diff(np.append(first, len(key)))) - rank, BITS + 1)
    seen = np.bitwise_or.reduceat(((state & ((1 << BITS) - 1)) | (1 << BITS)) >> lag, first)
    merged = (top << BITS) | (seen & ((1 << BITS) - 1))
    return key[first] >> 20, {"registers": (key[first] & ((1 << 20) - 1)).astype(np.int32), "states": merged.astype(np.int32)}


def estimates(group: np.ndarray, states: np.ndarray, groups: int, precision: int = PRECISION) -> np.ndarray:
    """Maximum likelihood estimates of ``groups`` sketches given as flat states.

    With x values expected in a register, a rank of level j is absent with
    probability exp(-x 2^-j).  The likelihood thus depends on a sum of what is
    known absent and on counts of what is present by level; its only maximum
    is found by bisection on log x, for all groups at once.
    """
    m, last = 1 << precision, 64 - precision
    states = states.astype(np.int64)
    rank = states >> BITS
    level = _level(rank, precision)
    present = np.zeros((groups, last + 1))
    np.add.at(present, (group, level), 1.0)
    # Ranks above the largest are absent: their total probability.
    cells = 1 << FINE
    absent = (cells * (1 - FINE + level) - rank) * np.exp2(-level.astype(float))
    for i in range(BITS):
        lower = rank - (BITS - i)
        valid = lower >= 1
        at = _level(np.maximum(lower, 1), precision)
        bit = (states >> i) & 1 > 0
        np.add.at(present, (group[valid & bit], at[valid & bit]), 1.0)
        absent += np.where(valid & ~bit, np.exp2(-at.astype(float)), 0.0)
    used = np.bincount(group, minlength=groups)
    alpha = np.bincount(group, absent, minlength=groups) + (m - used)  # untouched registers lack every rank
    scale = np.exp2(-np.arange(last + 1, dtype=float))
    lo, hi = np.full(groups, -80.0), np.full(groups, 80.0)
    for _ in range(64):
        mid = (lo + hi) / 2
        with np.errstate(over="ignore", divide="ignore"):
            slope = (present * scale / np.expm1(np.exp(mid)[:, None] * scale)).sum(1) - alpha
        lo, hi = np.where(slope > 0, mid, lo), np.where(slope > 0, hi, mid)
    return np.where(used > 0, m * np.exp((lo + hi) / 2), 0.0)


def sketches(rows: DataFrame, value: Column, keys: list[str], sets: list[list[str]], precision: int = PRECISION) -> DataFrame:
    """Mergeable sketches of ``value`` for each group.

    Null values are not counted, an empty text is a value, null keys are a group
    like others; a group without values, so also an empty table, has no row.
    """
    hashed = rows.where(value.isNotNull()).select(*keys, F.xxhash64(value).alias("_hash"))
    return summarise(hashed, keys, sets, ["_hash"], FIELDS, lambda h: lift(h, precision), merge, lossless=True)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of unions: of stored parts or days that share ``keys``."""
    return merge_summaries(parts, keys, FIELDS, merge)


def estimate(parts: DataFrame, precision: int = PRECISION) -> DataFrame:
    """``parts`` with ``distinct`` and ``error`` (relative standard error) for ``registers`` and ``states``."""

    @F.pandas_udf("double")
    def count(states):  # noqa: ANN001, ANN202
        import pandas as pd

        lengths = states.map(len).to_numpy()
        flat = np.concatenate(states.to_list()) if lengths.sum() else np.empty(0, np.int64)
        return pd.Series(estimates(np.repeat(np.arange(len(states)), lengths), flat, len(states), precision))

    return parts.withColumn("distinct", count("states")).withColumn("error", F.lit(standard_error(precision)))
