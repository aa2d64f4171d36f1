"""SQL twins, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from itertools import combinations

from seqlume.llm.lookalike import TABLE, by_table

_P1 = """
WITH recs AS (
  SELECT DISTINCT read_idx AS rid, upper(sequence) AS s FROM long_reads WHERE read_idx IS NOT NULL
  UNION ALL SELECT -CAST(adapter_id AS BIGINT) - 1, upper(sequence) FROM adapters),
w AS (SELECT rid, unnest(range(0, length(s) - 39)) AS i, s FROM recs WHERE length(s) >= 40),
k AS (SELECT rid, i, substr(s, CAST(i AS INT) + 1, 40) AS k FROM w),
ok AS (SELECT * FROM k WHERE regexp_full_match(k, '[ACGT]{40}')),
sh AS (SELECT k FROM ok GROUP BY k HAVING min(rid) <> max(rid)),
hit AS (SELECT DISTINCT rid, i FROM ok JOIN sh USING (k) WHERE rid >= 0),
mark AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 40 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM mark),
found AS (SELECT rid AS read_idx, CAST(min(i) AS INT) AS span_start, CAST(max(i) + 40 AS INT) AS span_end FROM run GROUP BY rid, g)
"""

_P5 = """
WITH s AS (SELECT read_idx, upper(sequence) AS k FROM short_reads WHERE length(sequence) > 0),
f AS (SELECT k, min(read_idx) AS first FROM s GROUP BY k),
p AS (SELECT DISTINCT upper(sequence) AS k FROM prior_sequences WHERE length(sequence) > 0)
SELECT s.read_idx FROM s JOIN f USING (k) LEFT JOIN p ON p.k = s.k WHERE s.read_idx > f.first OR p.k IS NOT NULL
"""


def _frequent(share: float, columns: str) -> str:
    return f"""
WITH s AS (SELECT upper(sequence) AS sequence FROM short_reads WHERE length(sequence) > 0),
t AS (SELECT count(*) AS total FROM s)
SELECT {columns} FROM (SELECT sequence, count(*) AS n FROM s GROUP BY 1), t WHERE n >= {share} * total
"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _look(column: str) -> str:
    """The form by table as an expression."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    gone = []
    for code, to in TABLE.items():
        if code >= 0x10000:
            continue
        (single if len(to) == 1 else several if to else {})[chr(code)] = to
        if not to:
            gone.append(f"\\x{{{code:x}}}")
    for code in range(0xC0, 0x2000):  # composed letters whose base is folded
        to = by_table(chr(code))
        if code not in TABLE and to != chr(code) and len(to) == 1:
            single[chr(code)] = to
    expression = f"regexp_replace({column}, '[{''.join(gone)}]', '', 'g')"
    for ch, to in several.items():
        expression = f"replace({expression}, '{_quoted(ch)}', '{_quoted(to)}')"
    return f"nfc_normalize(translate({expression}, '{_quoted(''.join(single))}', '{_quoted(''.join(single.values()))}'))"


def _words(table: str, id_col: str) -> str:
    look = _look("text")
    shown = f"regexp_replace({look}, '\\\\(emph|text[a-z]{{2,6}}|math[a-z]{{2,4}}|underline|uppercase|mbox)\\s*\\{{|\\\\[-/]', '', 'g')"
    shown = f"regexp_replace({shown}, '\\\\\\\\|\\\\[a-zA-Z]+\\*?', ' ', 'g')"
    shown = f"lower(replace(replace({shown}, '{{', ''), '}}', ''))"
    return f"SELECT {id_col} AS id, regexp_extract_all({shown}, '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS w FROM {table} WHERE text IS NOT NULL AND {id_col} IS NOT NULL"


def _leaks() -> str:
    windows = "SELECT id, array_to_string(w[CAST(i AS INT):CAST(i AS INT) + 11], ' ') AS k FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM {0} WHERE len(w) >= 12)"
    return f"""
WITH d AS ({_words('documents', 'doc_id')}), e AS ({_words('eval_items', 'item_id')}),
dw AS ({windows.format('d')}), ew AS ({windows.format('e')})
SELECT DISTINCT dw.id AS doc_id, ew.id AS item_id FROM dw JOIN ew USING (k)
"""


def _same_look() -> str:
    return f"""
WITH c AS (SELECT doc_id, text, {_look('text')} AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
v AS (SELECT * FROM c WHERE regexp_matches(form, '[^\\s]'))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM v a JOIN v b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text
"""


def _look_classes() -> str:
    return f"""
WITH c AS (SELECT doc_id, text, {_look('text')} AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
v AS (SELECT * FROM c WHERE regexp_matches(form, '[^\\s]')),
g AS (SELECT form, min(doc_id) AS class_id, count(*) AS docs, count(DISTINCT text) AS texts FROM v GROUP BY form)
SELECT DISTINCT doc_id, class_id, docs, texts FROM v JOIN g USING (form)
"""


def _sets(keys: dict[str, str], sets: list[list[str]], source: str, aggregates: str) -> str:
    """A row for each group of each set of ``keys`` (name to expression), with the set's name."""
    parts = []
    for chosen in sets:
        columns = ", ".join(f"{e if k in chosen else 'NULL'} AS {k}" for k, e in keys.items())
        parts.append(f"SELECT '{','.join(chosen)}' AS grouping, {columns}, {aggregates} FROM {source} GROUP BY ALL HAVING count(*) > 0")
    return " UNION ALL ".join(parts)


def _distinct_groups() -> str:
    keys = {"day": "CAST(seen_at AS DATE)", "run_id": "run_id", "sample": "sample", "mate": "mate"}
    sets = [list(c) for n in range(len(keys) + 1) for c in combinations(keys, n)]
    return _sets(keys, sets, "(SELECT * FROM short_reads WHERE sequence IS NOT NULL)", "true AS within")


def _length_groups() -> str:
    keys = {k: k for k in ("technology", "run_id", "sample", "day")}
    sets = [[], ["technology"], ["technology", "run_id"], ["technology", "sample"], ["technology", "day"], list(keys)]
    rows = """(SELECT 'illumina' AS technology, run_id, sample, CAST(seen_at AS DATE) AS day, coalesce(length(sequence), 0) AS length FROM short_reads
UNION ALL SELECT 'nanopore', run_id, sample, CAST(start_time AS DATE), coalesce(length(sequence), 0) FROM (SELECT DISTINCT ON (read_idx) * FROM long_reads))"""
    return _sets(keys, sets, rows, "count(*) AS reads, CAST(sum(length) AS BIGINT) AS bases, true AS within")


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT read_idx, span_start, span_end FROM found",
        "p1_shared": _P1 + """, r AS (SELECT read_idx, CAST(coalesce(max(length(sequence)), 0) AS BIGINT) AS length FROM long_reads WHERE read_idx IS NOT NULL GROUP BY 1),
f AS (SELECT read_idx, CAST(sum(span_end - span_start) AS BIGINT) AS shared, count(*) AS spans FROM found GROUP BY 1)
SELECT r.read_idx, r.length, coalesce(f.shared, 0) AS shared_bases, coalesce(f.spans, 0) AS spans,
  CASE WHEN r.length > 0 THEN round(coalesce(f.shared, 0) / r.length, 6) ELSE 0.0 END AS shared_fraction FROM r LEFT JOIN f USING (read_idx)""",
        "p2_within": _distinct_groups(),
        "p4_within": _length_groups(),
        "p5_found": _P5,
        "p5_counts": f"SELECT (SELECT count(*) FROM short_reads WHERE length(sequence) > 0) AS keys, (SELECT count(*) FROM ({_P5})) AS repeats, CAST(0 AS BIGINT) AS missed, true AS within",
        "p6_found": _frequent(0.01, "sequence"),
        "p6_frequent": _frequent(0.001, "sequence, n, round(n / total, 9) AS share"),
        "p8_found": _leaks(),
        "p9_found": _same_look(),
        "p9_classes": _look_classes(),
    }
