"""What a sequence is: shared k-mers first, then local alignment with the candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlume.functions.columns import canonical, norm, reverse_complement
from seqlume.plans.arrow import text_bytes
from seqlume.plans.scratch import materialise

K = 13
LONGEST_QUERY = 31


def canonical_kmers(sequence: Column, k: int = K) -> Column:
    """Distinct canonical k-mers of a sequence, those with N left out; k must be odd."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    n = F.length(sequence)
    cut = F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(sequence, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.filter(cut, lambda x: ~F.contains(x, F.lit("N"))), canonical))


def kmer_matches(queries: DataFrame, library: DataFrame, k: int = K, query_col: str = "query") -> DataFrame:
    """``query``, ``name`` and the number ``n`` of canonical k-mers they share."""
    q = queries.select(F.col(query_col).alias("query")).distinct().select("query", F.explode(canonical_kmers(norm(F.col("query")), k)).alias("kmer"))
    t = library.select("name", F.explode(canonical_kmers(norm(F.col("sequence")), k)).alias("kmer"))
    return q.join(t, "kmer").groupBy("query", "name").agg(F.count("*").alias("n"))


def _matches(targets: pa.Array, queries: pa.Array, match: int = 1, mismatch: int = -1, deletion: int = -1, insertion: int = -1) -> np.ndarray:
    """Matching query bases of the best local alignment, all pairs at once.

    Of equal scores the diagonal comes first, then an insertion (which costs a
    match), then a deletion; of equal best cells the one with most matches counts.
    """
    (dt, ot), (dq, oq) = text_bytes(targets), text_bytes(queries)
    nt, nq = np.diff(ot), np.diff(oq)
    rows, wide, tall = len(nt), int(nq.max(initial=0)), int(nt.max(initial=0))
    if wide > LONGEST_QUERY:
        raise ValueError(f"queries may have {LONGEST_QUERY} bases at most")
    q = np.zeros((wide, rows), np.uint8)
    for j in range(wide):
        has = nq > j
        q[j, has] = dq[oq[:-1][has] + j]
    score, found = np.zeros((wide + 1, rows), np.int16), np.zeros((wide + 1, rows), np.int16)
    best, most = np.zeros(rows, np.int16), np.zeros(rows, np.int16)
    for i in range(tall):
        live = nt > i
        base = np.zeros(rows, np.uint8)
        base[live] = dt[ot[:-1][live] + i]
        new_score, new_found = np.zeros_like(score), np.zeros_like(found)
        for j in range(1, wide + 1):
            same = base == q[j - 1]
            straight = score[j - 1] + np.where(same, match, mismatch)
            inserted, deleted = score[j] + insertion, new_score[j - 1] + deletion
            diagonal = (straight >= inserted) & (straight >= deleted)
            into = inserted >= deleted
            s = np.where(diagonal, straight, np.where(into, inserted, deleted))
            m = np.where(diagonal, found[j - 1] + same, np.where(into, found[j] - 1, new_found[j - 1]))
            m = np.where(s < 0, 0, m)
            s = np.maximum(s, 0)
            new_score[j], new_found[j] = s, m
            counted = live & (nq >= j)
            higher, equal = counted & (s > best), counted & (s == best) & (m > most)
            most = np.where(higher | equal, m, most)
            best = np.where(higher, s, best)
        score, found = new_score, new_found
    return most


@F.arrow_udf(T.DoubleType())
def sequence_identity(target: pa.Array, query: pa.Array) -> pa.Array:
    """Share of a query (31 bases at most) that matches in the best local alignment; 0 for an empty one."""
    _, offsets = text_bytes(query)
    return pa.array(_matches(target, query) / np.maximum(np.diff(offsets), 1))


def identified(queries: DataFrame, library: DataFrame, k: int = K, query_col: str = "query") -> DataFrame:
    """``query``, ``matches``, ``length`` and the ``name`` of the best match, or "No match".

    Candidates share a k-mer; either strand is aligned.  Of equal identities the
    candidate with more shared k-mers wins, then the shorter, then the later name.
    Queries without any match are tried again with k - 2 and k - 4.
    """
    texts = library.groupBy("name").agg(F.max(norm(F.col("sequence"))).alias("target"))
    left = queries.select(F.col(query_col).alias("query")).where("query is not null").distinct()
    done = None
    for size in (k, k - 2, k - 4):
        open_ = left if done is None else left.join(done, "query", "left_anti")
        pairs = kmer_matches(open_, library, size).join(texts, "name")
        s = norm(F.col("query"))
        identity = F.greatest(sequence_identity("target", s), sequence_identity("target", reverse_complement(s)))
        order = Window.partitionBy("query").orderBy(F.desc("identity"), F.desc("n"), F.length("target"), F.desc("name"))
        best = pairs.withColumn("identity", identity).where("identity > 0").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("query", "name", "identity")
        best = materialise(best, "identified")
        done = best if done is None else done.unionByName(best)
    n = F.length("query")
    return left.join(done, "query", "left").select("query", F.coalesce(F.bround(F.col("identity") * n), F.lit(0)).cast("int").alias("matches"), n.alias("length"), F.coalesce("name", F.lit("No match")).alias("name"))
