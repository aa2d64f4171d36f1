"""The library's functions under SQL names: ``register(spark)``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from seqlume.operators.identify import sequence_identity
from seqlume.operators.pairs import insert_size
from seqlume.operators.reads import scores

#: SQL functions whose bodies are plain SQL, inlined by the optimizer.
_INLINE = {
    "seq_norm(s STRING) RETURNS STRING": "regexp_replace(upper(s), '[^ACGT]', 'N')",
    "seq_revcomp(s STRING) RETURNS STRING": "reverse(translate(regexp_replace(upper(s), '[^ACGT]', 'N'), 'ACGT', 'TGCA'))",
    "seq_canonical(s STRING) RETURNS STRING": "least(regexp_replace(upper(s), '[^ACGT]', 'N'), reverse(translate(regexp_replace(upper(s), '[^ACGT]', 'N'), 'ACGT', 'TGCA')))",
    "phred_error(q INT) RETURNS DOUBLE": "CASE WHEN q BETWEEN 0 AND 93 THEN pow(10D, -q / 10D) END",
    "phred_bin(q INT) RETURNS INT": "shiftright(CASE WHEN q > 47 THEN 47 ELSE q END, 2)",
}


#: Where fragments begin, and the table of them: plain SQL as well, so a call is planned as a projection and an explode.
_PLACES = """fragment_places(n INT, k INT, from_start INT, from_end INT) RETURNS ARRAY<INT> RETURN
CASE WHEN n >= k THEN filter(concat(
    transform(sequence(0, n div k), i -> CASE WHEN i < (CASE WHEN from_start < 0 THEN n ELSE ceil(from_start / k) END) AND i < ceil(n / k) - floor(ceil(n / k) / 2) THEN int(i * k) END),
    transform(reverse(sequence(0, n div k)), i -> CASE WHEN i < (CASE WHEN from_end < 0 THEN n ELSE ceil(from_end / k) END) AND i < floor(ceil(n / k) / 2) THEN int(n - (i + 1) * k) END)
), p -> p IS NOT NULL) ELSE CAST(array() AS ARRAY<INT>) END"""
_FRAGMENTS = """fragments(s STRING, k INT, from_start INT, from_end INT) RETURNS TABLE(at INT, fragment STRING) RETURN
SELECT at, seq_canonical(substr(s, at + 1, k)) FROM (SELECT explode(places) AS at FROM (SELECT fragment_places(length(s), k, from_start, from_end) AS places)) WHERE upper(substr(s, at + 1, k)) NOT RLIKE '[^ACGT]'"""


def register(spark: SparkSession) -> None:
    """seq_norm, seq_revcomp, seq_canonical, phred_error, phred_bin, seq_identity, insert_size, read_scores and the table function fragments."""
    for signature, body in _INLINE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("seq_identity", sequence_identity)
    spark.udf.register("insert_size", insert_size)
    spark.udf.register("read_scores", scores)
    for body in (_PLACES, _FRAGMENTS):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
