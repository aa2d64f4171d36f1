"""Mates: pairing them, and the overlap of a pair."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlume.functions.columns import read_id, same_template
from seqlume.plans.arrow import text_bytes

OVERLAP = 16
TAIL = 31

_COMPLEMENT = np.zeros(256, np.uint8)
for _a, _b in zip("ACGTacgt", "TGCATGCA", strict=True):
    _COMPLEMENT[ord(_a)] = ord(_b)
_UPPER = np.array([ord(chr(c).upper()) if c < 128 else c for c in range(256)], np.uint8)


def zipped(first: DataFrame, second: DataFrame, order_col: str = "read_idx") -> DataFrame:
    """Mates of two files by place: ``read_idx``, both mates' columns, and ``problem``.

    ``problem`` is null for a pair, else "read 1 only", "read 2 only" or "names differ".
    """
    a = first.select(F.col(order_col).alias("read_idx"), *[F.col(c).alias(f"{c}1") for c in ("name", "sequence", "qualities")], F.lit(True).alias("has1"))
    b = second.select(F.col(order_col).alias("read_idx"), *[F.col(c).alias(f"{c}2") for c in ("name", "sequence", "qualities")], F.lit(True).alias("has2"))
    problem = F.when(F.col("has2").isNull(), "read 1 only").when(F.col("has1").isNull(), "read 2 only").when(~F.coalesce(same_template(F.col("name1"), F.col("name2")), F.lit(False)), "names differ")
    return a.join(b, "read_idx", "full_outer").withColumn("problem", problem).drop("has1", "has2")


def template(name: Column) -> Column:
    """What the mates of a pair share of their headers."""
    return F.regexp_replace(read_id(name), "/[12]$", "")


def mates(reads: DataFrame, keys: list[str], order_col: str = "read_idx", mate_col: str = "mate") -> DataFrame:
    """Mates of one table by header: ``keys``, ``template``, and of each mate the first delivery.

    One shuffle on the template; rows of other mate numbers or null headers are left out.
    """
    chosen = reads.where(F.col(mate_col).isin(1, 2) & F.col("name").isNotNull())
    row = F.struct(F.col(order_col).alias("at"), "name", F.upper("sequence").alias("sequence"), "qualities")
    one = [F.min(F.when(F.col(mate_col) == m, row)).alias(f"m{m}") for m in (1, 2)]
    paired = chosen.groupBy(*keys, template(F.col("name")).alias("template")).agg(*one)
    parts = [F.col(f"m{m}.{c}").alias(f"{'read_idx' if c == 'at' else c}{m}") for m in (1, 2) for c in ("at", "name", "sequence", "qualities")]
    problem = F.when(F.col("m2").isNull(), "read 1 only").when(F.col("m1").isNull(), "read 2 only")
    return paired.select(*keys, "template", *parts, problem.alias("problem"))


def _padded(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """A row for each text, filled with 0."""
    lengths = np.diff(offsets)
    matrix = np.zeros((len(lengths), width), np.uint8)
    inside = np.arange(width) < lengths[:, None]
    matrix[inside] = data
    return matrix


def _insert(s1: pa.Array, s2: pa.Array) -> np.ndarray:
    (d1, o1), (d2, o2) = text_bytes(s1), text_bytes(s2)
    n1, n2 = np.diff(o1), np.diff(o2)
    result = np.zeros(len(n1), np.int32)
    use = np.flatnonzero((n1 >= OVERLAP) & (n2 >= OVERLAP))
    # Rows of similar length together, so that padding stays small.
    use = use[np.argsort(n1[use], kind="stable")]
    at = 0
    while at < len(use):
        size = max(1, 2_000_000 // max(1, int(n1[use[min(at + 4096, len(use)) - 1]])))
        rows = use[at : at + min(size, 4096)]
        at += len(rows)
        width = int(n1[rows].max())
        own = np.concatenate([d1[o1[r] : o1[r + 1]] for r in rows])
        text = _padded(_UPPER[own], np.concatenate([[0], np.cumsum(n1[rows])]), width)
        places = width - OVERLAP + 1
        best = np.full(len(rows), 2 * places, np.int64)  # twice the place, plus 1 for the second needle
        for which, begin in ((0, o2[rows]), (1, o2[rows + 1] - OVERLAP)):
            needle = _COMPLEMENT[d2[begin[:, None] + np.arange(OVERLAP)]][:, ::-1]
            wrong = np.zeros((len(rows), places), np.uint8)
            for j in range(OVERLAP):
                wrong += text[:, j : j + places] != needle[:, j : j + 1]
            hit = (wrong <= 1) & (np.arange(places) <= (n1[rows] - OVERLAP)[:, None])
            where = hit.argmax(1)
            best = np.minimum(best, np.where(hit.any(1), 2 * where + which, 2 * places))
        found = best < 2 * places
        result[rows] = np.where(found, best // 2 + np.where(best % 2 == 0, OVERLAP, n2[rows]), 0)
    return result


@F.arrow_udf(T.IntegerType())
def insert_size(first: pa.Array, second: pa.Array) -> pa.Array:
    """Length of the sequenced molecule, 0 if the mates do not overlap.

    The reverse complement of the first or last 16 bases of read 2 is sought in
    read 1 with one mismatch at most; the first place wins, and at one place
    the needle from the start of read 2.  N matches nothing.
    """
    return pa.array(_insert(first, second))


def insert_sizes(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, both sequences and ``insert`` of each pair."""
    return pairs.where("problem is null").select(*keep, "sequence1", "sequence2", insert_size("sequence1", "sequence2").alias("insert"))


def insert_histogram(sized: DataFrame, by: list[str]) -> DataFrame:
    """Pairs by insert size; 0 stands for no overlap."""
    return sized.groupBy(*by, "insert").agg(F.count("*").alias("n"))


def overlap_adapters(sized: DataFrame, by: list[str], size: int = TAIL) -> DataFrame:
    """What follows the molecule in either mate: ``mate``, ``adapter`` (``size`` bases at most) and ``n``."""
    ends = F.array(*[F.struct(F.lit(m).alias("mate"), F.substr(F.col(f"sequence{m}"), F.col("insert") + 1, F.lit(size)).alias("adapter")) for m in (1, 2)])
    return sized.where("insert > 0").select(*by, F.inline(ends)).where("length(adapter) > 0").groupBy(*by, "mate", "adapter").agg(F.count("*").alias("n"))


def top_by_length(adapters: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent adapter of each length; of equal ones the first in order."""
    order = Window.partitionBy(*by, "mate", F.length("adapter")).orderBy(F.desc("n"), "adapter")
    return adapters.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*by, "mate", F.length("adapter").alias("length"), "adapter", "n")


