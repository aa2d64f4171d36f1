"""SQL twins of the core queries, for DuckDB over the same tables."""

from __future__ import annotations

from seqlume.functions.columns import ERRORS
from seqlume.operators.dedup import BUCKET_LABELS, BUCKETS
from seqlume.operators.profile import BIN_ERRORS, PHRED_LABELS, SERIES
from seqlume.operators.reads import LIMITS, PERCENTILES
from seqlume.plans.bins import growing, label

_E = "[" + ",".join(map(str, ERRORS)) + "]"
_NAMES = "[" + ",".join(f"'{x}'" for x in PHRED_LABELS) + "]"
_BIN_ERRORS = "[" + ",".join(repr(e) + "::DOUBLE" for e in BIN_ERRORS) + "]"
_GROWING = growing(1 << 22)
_BINS = "bins AS (SELECT * FROM (VALUES " + ",".join(f"({i},{a},{b},'{label(a, b)}')" for i, (a, b) in enumerate(_GROWING)) + ") t(bin, start, stop, label))"

_NORM = "coalesce(regexp_replace(upper(sequence), '[^ACGT]', 'N', 'g'), '')"
_USABLE = "CASE WHEN length(sequence) = length(qualities) AND NOT regexp_matches(qualities, '[^!-~]') THEN qualities END"
_SHORT = f"r AS (SELECT read_idx, run_id, sample, mate, name, {_NORM} AS s, {_USABLE} AS q FROM short_reads)"
_LONG = f"r AS (SELECT read_idx, any_value(name) AS name, any_value({_NORM}) AS s, any_value({_USABLE}) AS q, any_value(channel) AS channel, any_value(start_time) AS start_time, any_value(duration) AS duration, any_value(parent_id) AS parent_id FROM long_reads GROUP BY read_idx)"
_WRITABLE = "SELECT name, sequence, qualities FROM short_reads WHERE name IS NOT NULL AND length(sequence) = length(qualities)"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"

_BASE = "b AS (SELECT mate, length(s) AS len, CAST(i AS INT) AS pos, substr(s, CAST(i AS INT) + 1, 1) AS base FROM (SELECT mate, s, unnest(range(0, length(s))) AS i FROM r WHERE length(s) > 0))"
_PHRED = "p AS (SELECT mate, length(q) AS len, CAST(i AS INT) AS pos, least(ord(substr(q, CAST(i AS INT) + 1, 1)) - 33, 47) // 4 AS code FROM (SELECT mate, q, unnest(range(0, length(q))) AS i FROM r WHERE length(q) > 0))"
_LONG_BASE = _BASE.replace("SELECT mate, ", "SELECT ")
_LONG_PHRED = _PHRED.replace("SELECT mate, ", "SELECT ")
_FACTS = f"""f AS (SELECT run_id, sample, mate, length(s) AS length, length(s) - length(translate(s, 'CG', '')) AS gc, length(s) - length(translate(s, 'ACGT', '')) AS acgt,
  CASE WHEN length(q) > 0 THEN len(list_filter({_E}, lambda t: CAST(list_sum(list_transform(str_split(q, ''), lambda c: {_E}[ord(c) - 32])) AS HUGEINT) <= CAST(t AS HUGEINT) * length(q))) - 1 END AS phred,
  CASE WHEN length(q) > 0 THEN len(list_filter(str_split(q, ''), lambda c: ord(c) >= 53)) ELSE 0 END AS q20 FROM r)"""
_BUCKET = "CASE WHEN acgt > 0 THEN CAST(floor(100.0::DOUBLE * gc / acgt + 0.5) AS INT) END"
_LENGTHS = "l AS (SELECT mate, length, count(*) AS n FROM (SELECT mate, length(s) AS length FROM r UNION ALL SELECT 0, length(s) FROM lr) GROUP BY ALL)"
_BOTH = f"{_SHORT}, {_LONG.replace('r AS', 'lr AS', 1)}, {_LENGTHS}"


def _histogram(value: str, name: str, top: int) -> str:
    return f"""WITH {_SHORT}, {_FACTS}, c AS (SELECT mate, {value} AS v, count(*) AS n FROM f WHERE {value} IS NOT NULL GROUP BY ALL),
m AS (SELECT mate, CAST(unnest(range(0, {top + 1})) AS INT) AS v FROM (SELECT DISTINCT mate FROM f))
SELECT m.mate, m.v AS {name}, coalesce(c.n, 0) AS n FROM m LEFT JOIN c ON c.mate = m.mate AND c.v = m.v"""


def _parity() -> str:
    """Mean scores from doubles added up in four lanes: sums in a fixed order are folds over lists."""
    rates = "[" + ",".join(repr(10 ** (-q / 10)) + "::DOUBLE" for q in range(94)) + "]"
    fold = "list_reduce({0}, lambda a, b: a + b)".format
    lanes = " + ".join(fold(f"w[{i + 1}:whole:4]") for i in range(4))
    return f"""WITH {_SHORT}, o AS (SELECT mate, {rates} AS t, q, length(q) AS len, greatest(length(q) - 1, 0) // 4 * 4 AS whole FROM r WHERE length(q) > 0),
x AS (SELECT mate, len, whole, list_transform(range(1, len + 1), lambda i: t[ord(substr(q, CAST(i AS INT), 1)) - 32]) AS w FROM o),
y AS (SELECT mate, len, {fold("list_prepend(CASE WHEN whole > 0 THEN " + lanes + " ELSE 0 END, w[whole + 1:])")} AS total FROM x),
c AS (SELECT mate, CAST(floor(-10 * log10(total / len)) AS INT) AS v, count(*) AS n FROM y GROUP BY ALL),
m AS (SELECT mate, CAST(unnest(range(0, 94)) AS INT) AS v FROM (SELECT DISTINCT mate FROM r))
SELECT m.mate, m.v AS phred, coalesce(c.n, 0) AS n FROM m LEFT JOIN c ON c.mate = m.mate AND c.v = m.v"""


_GC = _histogram(_BUCKET, "gc", 100)


def _spread(source: str, by: str, counts: str) -> str:
    part = f"{by}, bin" if by else "bin"
    lead = f"{by}, " if by else ""
    sums = ", ".join(f"sum(least(greatest(CAST(floor(total * {p / 100!r}::DOUBLE) AS BIGINT) - before, 0), n) * e) AS w{p}" for p in SERIES)
    rows = ["SELECT {0}bin, 'mean' AS series, round(-10 * log10(all_ / total), 4) AS phred FROM w"]
    for p in SERIES:
        cut = f"CAST(floor(total * {p / 100!r}::DOUBLE) AS BIGINT)"
        if p <= 50:
            rows.append("SELECT {0}bin, 'bottom " + str(p) + f"', CASE WHEN {cut} > 0 THEN round(-10 * log10(w{p} / {cut}), 4) ELSE 0 END FROM w")
        if p >= 50:
            rows.append("SELECT {0}bin, 'top " + str(100 - p) + f"', CASE WHEN {cut} > 0 THEN round(-10 * log10((all_ - w{p}) / (total - {cut})), 4) ELSE 0 END FROM w")
    union = " UNION ALL ".join(r.replace("{0}", lead) for r in rows)
    return f"""WITH {source}, k AS ({counts}),
x AS (SELECT *, {_BIN_ERRORS}[code + 1] AS e, CAST(coalesce(sum(n) OVER (PARTITION BY {part} ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
  CAST(sum(n) OVER (PARTITION BY {part}) AS BIGINT) AS total FROM k),
w AS (SELECT {lead}bin, sum(n * e) AS all_, any_value(total) AS total, {sums} FROM x GROUP BY ALL)
{union}"""


def _adapters(technology: str) -> str:
    return f"""a AS (SELECT bases, arg_max(position, name || '|' || position) AS position FROM (SELECT regexp_replace(upper(sequence), '[^ACGT]', 'N', 'g') AS bases, trim(name) AS name, lower(trim(sequence_position)) AS position
  FROM adapters WHERE lower(trim(sequencing_technology)) IN ('{technology}', 'all') AND length(sequence) > 0) GROUP BY bases)"""


_HITS = "h AS (SELECT {0}bases AS adapter, CAST(instr(s, bases) - 1 AS INT) AS pos, CAST(length(s) - instr(s, bases) AS INT) AS back FROM r, a WHERE instr(s, bases) > 0)"


def _curve(view: str) -> str:
    place, size, reached = {
        "all": ("pos", "(SELECT max(length(s)) FROM r)", "CASE WHEN position = 'end' THEN l ELSE g END"),
        "front": ("CASE WHEN pos < 100 THEN pos END", "least(100, (SELECT max(length(s)) FROM r))", "g"),
        "end": ("CASE WHEN back < least(100, (SELECT max(length(s)) FROM r)) THEN least(100, (SELECT max(length(s)) FROM r)) - 1 - back END", "least(100, (SELECT max(length(s)) FROM r))", "l"),
    }[view]
    return f"""WITH {_SHORT}, {_adapters('illumina')}, {_HITS.format('mate, ')}, c AS (SELECT mate, adapter, {place} AS bin, count(*) AS n FROM h GROUP BY ALL),
t AS (SELECT mate, count(*) AS reads FROM r GROUP BY 1), m AS (SELECT mate, reads, bases AS adapter, position, CAST(unnest(range(0, CAST({size} AS BIGINT))) AS INT) AS bin FROM t, a),
j AS (SELECT m.*, coalesce(c.n, 0) AS n FROM m LEFT JOIN c USING (mate, adapter, bin)),
o AS (SELECT *, sum(n) OVER (PARTITION BY mate, adapter ORDER BY bin) AS l, sum(n) OVER (PARTITION BY mate, adapter ORDER BY bin DESC) AS g FROM j)
SELECT mate, adapter, bin, round(CAST({reached} AS DOUBLE) * 100 / reads, 6) AS percent FROM o"""


_TILES = f"""WITH {_SHORT}, x AS (SELECT mate, CAST(nullif(regexp_extract(name, '^(?:[^:]*:){{4}}([0-9]{{1,18}}):', 1), '') AS BIGINT) AS tile, q FROM r WHERE length(q) > 0),
te AS (SELECT mate, tile, CAST(i AS INT) AS pos, CAST(sum(CAST(round({_E}[ord(substr(q, CAST(i AS INT) + 1, 1)) - 32] / 1000.0) AS BIGINT)) AS BIGINT) AS error, count(*) AS n
  FROM (SELECT mate, tile, q, unnest(range(0, length(q))) AS i FROM x WHERE tile IS NOT NULL) GROUP BY ALL)"""
_DEVIATION = _TILES + """, m AS (SELECT mate, tile, pos AS bin, error / 1e9 / greatest(n, 1) AS mean FROM te),
fr AS (SELECT mate, tile, CAST(unnest(range(0, (SELECT max(pos) + 1 FROM te))) AS INT) AS bin FROM (SELECT DISTINCT mate, tile FROM te)),
sc AS (SELECT mate, tile, bin, CASE WHEN coalesce(mean, 0) > 0 THEN -10 * log10(mean) ELSE 0 END AS score FROM fr LEFT JOIN m USING (mate, tile, bin)),
dv AS (SELECT mate, tile, bin, round(score, 4) AS score, round(score - avg(score) OVER (PARTITION BY mate, bin), 4) AS deviation FROM sc)"""

_FRAGMENTS = f"""WITH {_SHORT}, n AS (SELECT mate, read_idx, s, CAST(length(s) AS INT) AS n, CAST(ceil(length(s) / 21.0) AS INT) AS mx FROM r WHERE read_idx % 8 = 0),
z AS (SELECT *, least(5, mx - mx // 2) AS a, least(5, mx // 2) AS b FROM n),
o AS (SELECT mate, read_idx, CASE WHEN n >= 21 THEN list_filter(list_transform(list_concat(list_transform(range(0, a), lambda i: i * 21), list_transform(range(0, b), lambda i: n - (b - i) * 21)),
  lambda p: substr(s, CAST(p AS INT) + 1, 21)), lambda x: NOT contains(x, 'N')) ELSE [] END AS raw FROM z),
fl AS (SELECT mate, read_idx, list_transform(raw, lambda x: least(x, {_RC.format('x')})) AS fr FROM o),
fc AS (SELECT mate, fragment, count(*) AS n FROM (SELECT mate, unnest(list_distinct(fr)) AS fragment FROM fl) GROUP BY ALL),
ft AS (SELECT mate, count(*) AS sampled, CAST(sum(len(fr)) AS BIGINT) AS total_fragments FROM fl GROUP BY ALL),
ov AS (SELECT mate, fragment, n, round(n / sampled, 6) AS fraction FROM fc JOIN ft USING (mate) WHERE n >= greatest(5, ceil(sampled * 0.001::DOUBLE)))"""
# The same with every 8th read of each mate.
_MATE_FRAGMENTS = _FRAGMENTS.replace("WHERE read_idx % 8 = 0", "QUALIFY (row_number() OVER (PARTITION BY mate ORDER BY read_idx) - 1) % 8 = 0")

_FINGERS = """WITH u AS (SELECT mate, coalesce(upper(sequence), '') AS s, CAST(length(coalesce(sequence, '')) AS INT) AS n FROM short_reads),
fp AS (SELECT mate, CASE WHEN n <= 16 THEN s ELSE substr(s, least((n - 16) // 2, 64) + 1, 8) || substr(s, n - 7, 8) END AS bases, CASE WHEN n <= 16 THEN 0 ELSE n >> 6 END AS length_class FROM u),
fc AS (SELECT mate, bases, length_class, count(*) AS n FROM fp GROUP BY ALL), dh AS (SELECT mate, n AS times, count(*) AS fingerprints FROM fc GROUP BY ALL)"""
_SLOT = "CASE " + " ".join(f"WHEN times <= {b} THEN {i}" for i, b in enumerate(BUCKETS)) + f" ELSE {len(BUCKETS)} END"
_BUCKET_ROWS = ",".join(f"({i},'{x}')" for i, x in enumerate(BUCKET_LABELS))

_MATES = """WITH c AS (SELECT run_id, sample, mate, regexp_replace(regexp_extract(name, '^[^ \\t]*'), '/[12]$', '') AS template, read_idx, upper(sequence) AS s FROM short_reads WHERE mate IN (1, 2) AND name IS NOT NULL),
mt AS (SELECT run_id, sample, template, min(read_idx) FILTER (WHERE mate = 1) AS read_idx1, min(read_idx) FILTER (WHERE mate = 2) AS read_idx2,
  arg_min(coalesce(s, '-'), read_idx) FILTER (WHERE mate = 1) AS s1, arg_min(coalesce(s, '-'), read_idx) FILTER (WHERE mate = 2) AS s2 FROM c GROUP BY ALL)"""
_PAIRS = _MATES + """, pr AS (SELECT s1, s2, CAST(length(s1) AS INT) AS n1, CAST(length(s2) AS INT) AS n2 FROM mt WHERE read_idx1 IS NOT NULL AND read_idx2 IS NOT NULL AND s1 <> '-' AND s2 <> '-'),
nd AS (SELECT *, reverse(translate(regexp_replace(left(s2, 16), '[^ACGT]', '.', 'g'), 'ACGT', 'TGCA')) AS a, reverse(translate(regexp_replace(right(s2, 16), '[^ACGT]', '.', 'g'), 'ACGT', 'TGCA')) AS b FROM pr),
sz AS (SELECT s1, s2, n1, n2, CASE WHEN least(n1, n2) < 16 THEN 0 ELSE coalesce(list_filter(list_transform(range(0, n1 - 15), lambda i: CASE WHEN hamming(substr(s1, CAST(i AS INT) + 1, 16), a) <= 1 THEN CAST(i AS INT) + 16
  WHEN hamming(substr(s1, CAST(i AS INT) + 1, 16), b) <= 1 THEN CAST(i AS INT) + n2 END), lambda v: v IS NOT NULL)[1], 0) END AS ins FROM nd),
oa AS (SELECT mate, adapter, count(*) AS n FROM (SELECT 1 AS mate, substr(s1, ins + 1, 31) AS adapter FROM sz WHERE ins > 0 UNION ALL SELECT 2, substr(s2, ins + 1, 31) FROM sz WHERE ins > 0) WHERE length(adapter) > 0 GROUP BY ALL)"""

_VALUE = "nullif(regexp_extract(name, '[ \\t]{0}(?:=|:[A-Za-z]:)([^ \\t]*)', 1), '')"
_TIME = f"epoch(coalesce(try_cast({_VALUE.format('start_time')} AS TIMESTAMPTZ), try_cast({_VALUE.format('st')} AS TIMESTAMPTZ)))"
_CHANNEL = f"CASE WHEN regexp_full_match({_VALUE.format('ch')}, '[0-9]{{1,18}}') THEN CAST({_VALUE.format('ch')} AS BIGINT) END"
_UUID = "regexp_full_match({0}, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-4[0-9a-fA-F]{{3}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')"
_NANO = f"""WITH {_LONG}, g AS (SELECT coalesce(CAST(channel AS BIGINT), {_CHANNEL}) AS channel, CAST(floor(coalesce(epoch(start_time), {_TIME})) AS BIGINT) AS start, coalesce(CAST(duration AS DOUBLE), try_cast({_VALUE.format('du')} AS DOUBLE)) AS duration,
  length(s) AS length, coalesce(CAST(list_sum(list_transform(str_split(nullif(q, ''), ''), lambda c: {_E}[ord(c) - 32])) AS HUGEINT), 0) / 1e12::DOUBLE AS error,
  coalesce({_UUID.format('coalesce(parent_id, ' + _VALUE.format('pi') + ')')}, false) AS split FROM r),
nf AS (SELECT *, CASE WHEN length > 0 AND error > 0 THEN CAST(round_even(-10 * log10(error / length), 0) AS INT) ELSE 0 END AS score FROM g)"""
_WIDTH = "greatest((CAST(ceil((last - first) / 200.0) AS BIGINT) + 59) // 60 * 60, 1)"
_SLOTS = _NANO + f""", rg AS (SELECT min(start) AS first, max(start) AS last FROM nf WHERE start > 0), w AS (SELECT *, {_WIDTH} AS width FROM rg),
sl AS (SELECT CAST((start - first) // width AS INT) AS slot, count(DISTINCT channel) AS channels, CAST(sum(length) AS BIGINT) AS bases, count(*) AS reads, {", ".join(f"count(*) FILTER (WHERE least(greatest(score, 0), 47) // 4 = {i}) AS bin{i}" for i in range(12))} FROM nf, w WHERE start > 0 GROUP BY 1),
sf AS (SELECT CAST(unnest(range(0, (last - first) // width + 1)) AS INT) AS slot, width FROM w WHERE first IS NOT NULL)
SELECT slot, CAST(slot * width AS BIGINT) AS "from", {", ".join(f"coalesce({c}, 0) AS {c}" for c in ["channels", "bases", "reads", *[f"bin{i}" for i in range(12)]])} FROM sf LEFT JOIN sl USING (slot)"""

_ILLUMINA = "regexp_matches(name, '^[^\\s:]*(?::[^\\s:]*){6}(?:\\s+(?:[^:]*:[YN]:[^:]*:[^:]*)?)?$')"
_NANOPORE = "regexp_matches(name, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\s') AND regexp_matches(name, '\\sch\\S*') AND regexp_matches(name, '\\sst\\S*')"


def _kmers(table: str, id_col: str, text: str) -> str:
    return f"""SELECT DISTINCT {id_col}, least(k, {_RC.format('k')}) AS kmer FROM (SELECT {id_col}, substr(s, CAST(i AS INT) + 1, 13) AS k FROM (SELECT {id_col}, s, unnest(range(0, length(s) - 12)) AS i
  FROM (SELECT {id_col}, regexp_replace(upper({text}), '[^ACGT]', 'N', 'g') AS s FROM {table}) WHERE length(s) >= 13)) WHERE NOT contains(k, 'N')"""


_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'


def _lines(select: str) -> str:
    def plain(name: str) -> str:
        return f"CASE WHEN starts_with({name}, '\"') THEN replace(substr({name}, 2, length({name}) - 2), '\"\"', '\"') ELSE {name} END"

    return f"""
WITH b AS (SELECT row_id, CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END AS line FROM raw_records),
x AS (SELECT row_id, line, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') AS quoted, regexp_full_match(line, '{_FIELD}(?:,{_FIELD}){{3}}') AS four,
  regexp_extract(line, '^({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})$', ['a', 'b', 'c', 'd']) AS f FROM b),
y AS (SELECT row_id, line, quoted, four, {plain("f.a")} AS sample, {plain("f.b")} AS name, {plain("f.c")} AS sequence, {plain("f.d")} AS qualities FROM x),
z AS (SELECT *, CASE WHEN line IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting' WHEN NOT four THEN 'columns'
  WHEN name = '' OR regexp_matches(name, '[^ -~]') THEN 'name'
  WHEN length(sequence) <> length(qualities) OR regexp_matches(qualities, '[^!-~]') THEN 'qualities' END AS reason FROM y)
{select}
"""


def _summary(by: str, where: str) -> str:
    return f"""WITH {_SHORT}, {_FACTS} SELECT {by}, round(sum(length) / greatest(count(*), 1), 6) AS mean_length, CAST(min(length) AS BIGINT) AS minimum_length, CAST(max(length) AS BIGINT) AS maximum_length,
count(*) AS total_reads, count(*) FILTER (WHERE phred >= 20) AS q20_reads, CAST(sum(length) AS BIGINT) AS total_bases, CAST(sum(q20) AS BIGINT) AS q20_bases, CAST(sum(gc) AS BIGINT) AS total_gc_bases,
CAST(sum(length - acgt) AS BIGINT) AS total_n_bases FROM f {where} GROUP BY {by}"""


def oracle_sql() -> dict[str, str]:
    start = f"WITH {_SHORT}, "
    running = f"WITH {_BOTH}, c AS (SELECT *, sum(n) OVER (PARTITION BY mate ORDER BY length) AS upto, sum(n) OVER (PARTITION BY mate) AS total, sum(length * n) OVER (PARTITION BY mate ORDER BY length) AS bases, sum(length * n) OVER (PARTITION BY mate) AS all_bases FROM l) "
    return {
        "base_counts": start + _BASE + " SELECT mate, pos, base, count(*) AS n FROM b GROUP BY ALL",
        "phred_counts": start + _PHRED + f" SELECT mate, pos, {_NAMES}[code + 1] AS phred, count(*) AS n FROM p GROUP BY ALL",
        "end_base_counts": start + _BASE + " SELECT mate, CAST(pos - len + 100 AS INT) AS pos, base, count(*) AS n FROM b WHERE pos >= len - 100 GROUP BY ALL",
        "end_phred_counts": start + _PHRED + f" SELECT mate, CAST(pos - len + 100 AS INT) AS pos, {_NAMES}[code + 1] AS phred, count(*) AS n FROM p WHERE pos >= len - 100 GROUP BY ALL",
        "front_base_counts": start + _BASE + " SELECT mate, pos, base, count(*) AS n FROM b WHERE pos < 100 GROUP BY ALL",
        "long_base_counts": f"WITH {_LONG}, {_LONG_BASE}, {_BINS}, c AS (SELECT pos, base, count(*) AS n FROM b GROUP BY ALL) SELECT bin, CAST(instr('ACGTN', base) - 1 AS INT) AS code, CAST(sum(n) AS BIGINT) AS n FROM c JOIN bins ON pos >= start AND pos < stop GROUP BY ALL",
        "gc_hist": _GC,
        "gc_smooth": f"SELECT mate, gc // 2 AS slot, CAST(sum(n) AS BIGINT) AS n FROM ({_GC}) GROUP BY ALL",
        "mean_phred_hist": _histogram("phred", "phred", 93),
        "mean_phred_parity": _parity(),
        "q_thresholds": start + _FACTS + " " + " UNION ALL ".join(f'SELECT mate, {q} AS "limit", count(*) FILTER (WHERE phred >= {q}) AS n, round(count(*) FILTER (WHERE phred >= {q}) / greatest(count(phred), 1), 6) AS fraction FROM f GROUP BY mate' for q in LIMITS),
        "summary": _summary("run_id, sample, mate", ""),
        "summary_cube": start + _FACTS + " SELECT sample, mate, count(*) AS total_reads, CAST(sum(length) AS BIGINT) AS total_bases, CAST(max(length) AS INT) AS maximum_length, CAST(grouping(sample, mate) AS BIGINT) AS level FROM f GROUP BY CUBE (sample, mate)",
        "length_dist": f"WITH {_BOTH}, {_BINS} SELECT 0 AS slot, '0' AS label, CAST(sum(n) AS BIGINT) AS n FROM l WHERE mate = 0 AND length = 0 HAVING count(*) > 0 UNION ALL SELECT bin + 1, label, CAST(sum(n) AS BIGINT) FROM l JOIN bins ON length - 1 >= start AND length - 1 < stop WHERE mate = 0 GROUP BY ALL",
        "length_percentiles": running + "SELECT mate, " + ", ".join(f"min(length) FILTER (WHERE upto > ({p} * total) // 100) AS q{p}" for p in PERCENTILES) + " FROM c GROUP BY mate",
        "n50_n90": running + "SELECT mate, coalesce(min(length) FILTER (WHERE all_bases // 2 > 0 AND bases >= all_bases // 2), 0) AS n50, coalesce(min(length) FILTER (WHERE floor(all_bases * 0.1::DOUBLE) > 0 AND bases >= floor(all_bases * 0.1::DOUBLE)), 0) AS n90 FROM c GROUP BY mate",
        "quality_fractions": start + _PHRED + ", c AS (SELECT mate, pos AS bin, CAST(code AS INT) AS code, count(*) AS n FROM p GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY mate, bin), 6) AS fraction FROM c",
        "end_quality_fractions": start + _PHRED + ", c AS (SELECT mate, CAST(pos - len + 100 AS INT) AS pos, CAST(code AS INT) AS code, count(*) AS n FROM p WHERE pos >= len - 100 GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY mate, pos), 6) AS fraction FROM c",
        "quality_percentiles": _spread(f"{_SHORT}, {_PHRED}", "mate", "SELECT mate, pos AS bin, code, count(*) AS n FROM p GROUP BY ALL"),
        "long_quality_percentiles": _spread(f"{_LONG}, {_LONG_PHRED}, {_BINS}, c AS (SELECT pos, code, count(*) AS n FROM p GROUP BY ALL)", "", "SELECT bin, code, CAST(sum(n) AS BIGINT) AS n FROM c JOIN bins ON pos >= start AND pos < stop GROUP BY ALL"),
        "base_content": start + _BASE + ", c AS (SELECT mate, pos AS bin, CAST(instr('ACGTN', base) - 1 AS INT) AS code, count(*) AS n FROM b WHERE base <> 'N' GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY mate, bin), 6) AS fraction FROM c",
        "n_content": start + _BASE + " SELECT mate, pos AS bin, count(*) FILTER (WHERE base = 'N') AS unknown, count(*) AS total, round(count(*) FILTER (WHERE base = 'N') / count(*), 6) AS fraction FROM b GROUP BY ALL",
        "adapter_hits": start + _adapters("illumina") + ", " + _HITS.format("mate, ") + " SELECT mate, adapter, pos, back, count(*) AS n FROM h GROUP BY ALL",
        "adapter_hits_long": f"WITH {_LONG}, " + _adapters("nanopore") + ", " + _HITS.format("") + " SELECT adapter, pos, back, count(*) AS n FROM h GROUP BY ALL",
        "adapter_curve": _curve("all"), "adapter_curve_front": _curve("front"), "adapter_curve_end": _curve("end"),
        "tile_errors": _TILES + " SELECT * FROM te",
        "tile_deviation": _DEVIATION + " SELECT * FROM dv",
        "tile_flags": _DEVIATION + " SELECT mate, tile, min(deviation) AS lowest, CASE WHEN min(deviation) <= -10 THEN '10x' ELSE '2x' END AS errors FROM dv GROUP BY ALL HAVING min(deviation) <= -3",
        "tile_skip": "SELECT mate, arg_min(name, read_idx) AS name, min(read_idx) AS read_idx FROM short_reads WHERE name IS NOT NULL AND regexp_extract(name, '^(?:[^:]*:){4}([0-9]{1,18}):', 1) = '' GROUP BY mate",
        "fragment_counts": _FRAGMENTS + " SELECT * FROM fc", "fragment_totals": _FRAGMENTS + " SELECT * FROM ft", "overrepresented": _FRAGMENTS + " SELECT * FROM ov",
        "fragment_first_come": _FRAGMENTS + """, pl AS (SELECT read_idx, fragment, n AS place FROM (SELECT read_idx, fr, unnest(fr) AS fragment, generate_subscripts(fr, 1) AS n FROM fl)),
fi AS (SELECT fragment, count(DISTINCT read_idx) AS n, min(struct_pack(read_idx, place)) AS first FROM pl GROUP BY 1) SELECT fragment, n FROM fi ORDER BY first LIMIT 5000""",
        "mate_fragment_counts": _MATE_FRAGMENTS + " SELECT * FROM fc", "mate_fragment_totals": _MATE_FRAGMENTS + " SELECT * FROM ft", "mate_overrepresented": _MATE_FRAGMENTS + " SELECT * FROM ov",
        "mate_fragment_first_come": _MATE_FRAGMENTS + """, pl AS (SELECT mate, read_idx, fragment, n AS place FROM (SELECT mate, read_idx, fr, unnest(fr) AS fragment, generate_subscripts(fr, 1) AS n FROM fl)),
fi AS (SELECT mate, fragment, count(DISTINCT read_idx) AS n, min(struct_pack(read_idx, place)) AS first FROM pl GROUP BY 1, 2) SELECT mate, fragment, n FROM fi QUALIFY row_number() OVER (PARTITION BY mate ORDER BY first) <= 5000000""",
        "fingerprint_counts": _FINGERS + " SELECT * FROM fc",
        "duplication_hist": _FINGERS + " SELECT * FROM dh",
        "duplication_remaining": _FINGERS + ' SELECT mate, CAST(sum(fingerprints) AS BIGINT) AS "unique", CAST(sum(times * fingerprints) AS BIGINT) AS reads, round(sum(fingerprints) / sum(times * fingerprints), 6) AS remaining FROM dh GROUP BY mate',
        "duplication_buckets": _FINGERS + f""", bk AS (SELECT mate, {_SLOT} AS slot, CAST(sum(times * fingerprints) AS BIGINT) AS reads FROM dh GROUP BY ALL), tt AS (SELECT mate, sum(times * fingerprints) AS total FROM dh GROUP BY 1),
fr AS (SELECT mate, total, slot, bucket FROM tt, (VALUES {_BUCKET_ROWS}) v(slot, bucket)) SELECT mate, slot, bucket, coalesce(reads, 0) AS reads, round(coalesce(reads, 0) / total, 6) AS fraction FROM fr LEFT JOIN bk USING (mate, slot)""",
        "fingerprint_errors": start + f"""k AS (SELECT mate, q, CAST(length(q) AS INT) AS n FROM r WHERE q IS NOT NULL),
fq AS (SELECT mate, CASE WHEN n <= 16 THEN q ELSE substr(q, least((n - 16) // 2, 64) + 1, 8) || substr(q, n - (least((n - 16) // 2, 64) + 8) + 1, 8) END AS f FROM k)
SELECT mate, CAST(round_even(coalesce(list_sum(list_transform(str_split(nullif(f, ''), ''), lambda c: {_E}[ord(c) - 32])), 0) / 1e12::DOUBLE, 0) AS INT) AS errors, count(*) AS n FROM fq GROUP BY ALL""",
        "exact_duplicates": "WITH c AS (SELECT mate, upper(coalesce(sequence, '')) AS s, count(*) AS n FROM short_reads GROUP BY ALL) SELECT mate, n AS times, count(*) AS fingerprints FROM c GROUP BY ALL",
        "adapter_presence": f"WITH a AS (SELECT DISTINCT regexp_replace(upper(sequence), '[^ACGT]', 'N', 'g') AS b FROM adapters WHERE length(sequence) > 0), e AS (SELECT b FROM a UNION ALL SELECT {_RC.format('b')} FROM a), p AS (SELECT regexp_replace(upper(sequence), '[^ACGT]', 'N', 'g') AS s FROM prior_sequences WHERE length(sequence) > 0) SELECT b AS adapter, count(*) AS n FROM e, p WHERE contains(s, b) GROUP BY 1",
        "pair_fingerprint_counts": _MATES + " SELECT left(s1, 8) || left(s2, 8) AS bases, CAST((length(s1) + length(s2)) >> 6 AS INT) AS length_class, count(*) AS n FROM mt WHERE read_idx1 IS NOT NULL AND read_idx2 IS NOT NULL AND s1 <> '-' AND s2 <> '-' GROUP BY ALL",
        "mate_join": _MATES + " SELECT run_id, sample, template, read_idx1, read_idx2, CASE WHEN read_idx2 IS NULL THEN 'read 1 only' WHEN read_idx1 IS NULL THEN 'read 2 only' END AS problem FROM mt",
        "source_fastq": _WRITABLE,
        "source_fastq_gz": _WRITABLE,
        "source_fastq_places": f"SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(*) AS BIGINT) AS places, true AS whole FROM ({_WRITABLE})",
        "source_bam": """SELECT DISTINCT ON (read_idx) regexp_extract(name, '^[^ \\t]*') AS name, regexp_replace(upper(coalesce(sequence, '')), '[^=ACMGRSVTWYHKDBN]', 'N', 'g') AS sequence,
CASE WHEN length(qualities) = length(coalesce(sequence, '')) THEN qualities ELSE repeat('!', length(coalesce(sequence, ''))) END AS qualities, coalesce(hex(tags), '') AS tags,
CASE WHEN hex(tags) LIKE '636853%' THEN CAST('0x' || substr(hex(tags), 9, 2) || substr(hex(tags), 7, 2) AS INT) END AS channel FROM long_reads WHERE name IS NOT NULL""",
        "source_fasta": "SELECT concat_ws(' ', trim(name), adapter_id) AS name, sequence FROM adapters",
        "source_adapters": "SELECT trim(name) AS name, sequencing_technology, sequence, sequence_position FROM adapters WHERE sequencing_technology IN ('nanopore', 'all')",
        "mate_zip": """WITH z AS (SELECT read_idx // 2 AS k, (min({'i': read_idx, 'n': name}) FILTER (WHERE mate = 1)).n AS a, (min({'i': read_idx, 'n': name}) FILTER (WHERE mate = 2)).n AS b, count(*) FILTER (WHERE mate = 1) AS na, count(*) FILTER (WHERE mate = 2) AS nb FROM short_reads GROUP BY 1),
i AS (SELECT na, nb, regexp_extract(a, '^[^ \\t]*') AS x, regexp_extract(b, '^[^ \\t]*') AS y FROM z WHERE na + nb > 0)
SELECT CASE WHEN nb = 0 THEN 'read 1 only' WHEN na = 0 THEN 'read 2 only' WHEN NOT coalesce(x = y OR (regexp_matches(x, '[12]$') AND regexp_matches(y, '[12]$') AND regexp_replace(x, '[12]$', '') = regexp_replace(y, '[12]$', '')), false) THEN 'names differ' END AS problem, count(*) AS n FROM i GROUP BY 1""",
        "insert_sizes": _PAIRS + ' SELECT ins AS "insert", count(*) AS n FROM sz GROUP BY ALL',
        "overlap_adapters": _PAIRS + " SELECT * FROM oa",
        "top_adapter_per_length": _PAIRS + " SELECT mate, CAST(length(adapter) AS INT) AS length, adapter, n FROM oa QUALIFY row_number() OVER (PARTITION BY mate, length(adapter) ORDER BY n DESC, adapter) = 1",
        "nano_slots": _SLOTS,
        "nano_channels": _NANO + " SELECT coalesce(channel, -1) AS channel, CAST(sum(length) AS BIGINT) AS bases, CASE WHEN sum(length) > 0 AND sum(error) > 0 THEN round(-10 * log10(sum(error) / sum(length)), 4) ELSE 0 END AS phred FROM nf GROUP BY 1",
        "translocation": _NANO + " SELECT CAST(least(CAST(round_even(length / duration, 0) AS BIGINT), 800) // 10 AS INT) AS slot, count(*) AS n FROM nf WHERE duration > 0 GROUP BY 1",
        "split_reads": _NANO + " SELECT count(*) AS reads, count(*) FILTER (WHERE split) AS with_parent FROM nf",
        "nano_skip": f"WITH {_LONG} SELECT arg_min(name, read_idx) AS name, min(read_idx) AS read_idx, count(*) AS n FROM r WHERE ({_CHANNEL}) IS NULL OR ({_TIME}) IS NULL",
        "tech_sniff": f"WITH {_LONG}, bt AS (SELECT 'short' AS \"table\", name FROM short_reads UNION ALL SELECT 'long', name FROM r) SELECT \"table\", CASE WHEN {_ILLUMINA} THEN 'illumina' WHEN {_NANOPORE} THEN 'nanopore' ELSE 'unknown' END AS technology, count(*) AS n FROM bt WHERE name IS NOT NULL GROUP BY ALL",
        "canonical_kmers": _kmers("adapters", "adapter_id", "sequence"),
        "mate_kmer_match": _MATE_FRAGMENTS + f", qk AS ({_kmers('(SELECT DISTINCT fragment FROM ov)', 'fragment', 'fragment')}), tk AS ({_kmers('(SELECT concat_ws(chr(32), trim(name), adapter_id) AS name, sequence FROM adapters)', 'name', 'sequence')}) SELECT fragment AS query, name, count(*) AS n FROM qk JOIN tk USING (kmer) GROUP BY ALL",
        "kmer_match": _FRAGMENTS + f", qk AS ({_kmers('(SELECT DISTINCT fragment FROM ov)', 'fragment', 'fragment')}), tk AS ({_kmers('(SELECT concat_ws(chr(32), trim(name), adapter_id) AS name, sequence FROM adapters)', 'name', 'sequence')}) SELECT fragment AS query, name, count(*) AS n FROM qk JOIN tk USING (kmer) GROUP BY ALL",
        "header_fields": f"WITH {_LONG}, u AS (SELECT read_idx, name, regexp_extract(name, '^[^ \\t]*') AS id FROM r) SELECT read_idx, {_CHANNEL} AS channel, CAST(floor({_TIME}) AS BIGINT) AS start, id, CASE WHEN {_UUID.format('id')} THEN CAST(CAST('0x' || left(id, 8) || substr(id, 29, 8) AS UBIGINT) AS VARCHAR) ELSE '0' END AS number FROM u",
        "p3_found": _lines("SELECT row_id, reason FROM z WHERE reason IS NOT NULL"),
        "p3_loaded": _lines("SELECT row_id, sample, name, sequence, qualities FROM z WHERE reason IS NULL"),
    }
