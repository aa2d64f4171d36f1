import pytest
from pyspark.sql import functions as F

from seqlume.functions import columns as C
from seqlume.plans import bins
from seqlume.sources import small


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*exprs).collect()]


def test_norm_and_reverse_complement(spark):
    rows = [("gattacaNx-",), ("",), (None,)]
    s = C.norm(F.col("s"))
    assert values(spark, rows, "s string", s, C.reverse_complement(s), C.canonical(s)) == [
        ("GATTACANNN", "NNNTGTAATC", "GATTACANNN"), ("", "", ""), (None, None, None)
    ]


def test_gc_bucket_rounds_half_up_and_leaves_n_out(spark):
    rows = [("GGNNN",), ("G" + "A" * 199,), ("G" * 3 + "A" * 197,), ("NNN",), ("",)]
    assert [v for v, in values(spark, rows, "s string", C.gc_bucket(F.col("s")))] == [100, 1, 2, None, None]


def test_phred(spark):
    rows = [("!",), ("I",), ("~",), (" ",)]
    q = C.phred(F.col("c"))
    got = values(spark, rows, "c string", q, C.phred_bin(q), C.error_rate(q))
    assert [g[:2] for g in got] == [(0, 0), (40, 10), (93, 11), (None, None)]
    assert got[1][2] == pytest.approx(1e-4)


@pytest.mark.parametrize("name,tile", [
    ("SIM:1:FCX:1:15:6329:1045 1:N:0:2", 15), ("a:b:c:d:007:x:y", 7), ("a:b:c:d:12", None), ("a:b:c:d::x", None), ("a:b:c:d:1x:y", None), ("a:b:c:d:" + "9" * 19 + ":x", None), ("", None),
])
def test_tile(spark, name, tile):
    assert values(spark, [(name,)], "n string", C.tile(F.col("n"))) == [(tile,)]


@pytest.mark.parametrize("a,b,match", [
    ("r", "r", True), ("r1", "r2", True), ("r/1 x", "r/2 y", True), ("r1", "r1", True), ("r3", "r4", False), ("r\tz", "r q", True), ("r1", "s2", False), ("", "", True), ("x1", "x", False),
])
def test_mate_names(spark, a, b, match):
    assert values(spark, [(a, b)], "a string, b string", C.same_template(F.col("a"), F.col("b"))) == [(match,)]


HEADERS = [
    ("SIM:1:FCX:1:15:6329:1045 1:N:0:2", "illumina"), ("SIM:1:FCX:1:15:6329:1045", "illumina"), ("SIM:1:FCX:1:15:6329:1045 1:X:0:2", None), ("SIM:1:FCX:1:15:6329 1:N:0:2", None),
    ("35eb0273-89e2-4093-98ed-d81cbdafcac7 ch=3 start_time=2020-01-01T00:00:00Z", "nanopore"), ("35eb0273-89e2-4093-98ed-d81cbdafcac7\tch:i:3\tst:Z:2020-01-01T00:00:00Z", "nanopore"),
    ("35eb0273-89e2-4093-98ed-d81cbdafcac7 ch=3", None), ("35eb0273-89e2-4093-98ed ch=3 st=1", None), ("", None),
]


@pytest.mark.parametrize("name,kind", HEADERS)
def test_technology_of_headers(spark, name, kind):
    assert values(spark, [(name,)], "n string", C.is_illumina(F.col("n")), C.is_nanopore(F.col("n"))) == [(kind == "illumina", kind == "nanopore")]
    assert small.header_technology(name) == kind


def test_header_values(spark):
    name = "id runid=x ch=12 start_time=2020-03-01T01:00:00+01:00 odd"
    got = values(spark, [(name,), ("id ch=x",), ("id\tch:i:7\tst:Z:2020-03-01T00:00:00Z",)], "n string", C.whole_number(C.header_value(F.col("n"), "ch")), F.unix_timestamp(C.header_time(F.col("n"))))
    assert got == [(12, 1583020800), (None, None), (7, 1583020800)]  # a leap day lies before it


@pytest.mark.parametrize("start,end,expected", [
    (100, 100, ["AAC", "CCG", "AAA", "AAA", "GCC", "CAA"]), (1, 0, ["AAC"]), (0, 1, ["CAA"]), (0, 0, []), (-1, -1, ["AAC", "CCG", "AAA", "AAA", "GCC", "CAA"]), (4, 6, ["AAC", "CCG", "GCC", "CAA"]),
])
def test_fragments_of_either_end(spark, start, end, expected):
    assert values(spark, [("AACCGGTTTTGGCCAA",)], "s string", C.fragments(F.col("s"), 3, start, end))[0][0] == expected


def test_fragments_of_short_reads_and_n(spark):
    rows = [("AC",), ("",), ("ACN" + "GTA",)]
    assert [v for v, in values(spark, rows, "s string", C.fragments(F.col("s"), 3, 100, 100))] == [[], [], ["GTA"]]


def test_fingerprints(spark):
    f = C.fingerprint(F.col("s"), 2, 2, 3, 0)
    rows = [("ACGT",), ("AACCGGTTAC",), ("A" * 200,), ("",)]
    assert [tuple(v) for v, in values(spark, rows, "s string", f)] == [("ACGT", 0), ("CGAC", 0), ("AAAA", 3), ("", 0)]
    p = C.pair_fingerprint(F.col("a"), F.col("b"), 3, 3, 1, 0)
    assert [tuple(v) for v, in values(spark, [("AACCGG", "TTTGG"), ("AC", "")], "a string, b string", p)] == [("ACCTTT", 0), ("AC", 0)]


def test_uuid(spark):
    rows = [("35eb0273-89e2-4093-98ed-d81cbdafcac7",), ("35eb0273-89e2-1093-98ed-d81cbdafcac7",), ("x",), (None,)]
    got = [int(v) for v, in values(spark, rows, "s string", C.uuid_number(F.col("s")))]
    assert got == [int("35eb0273bdafcac7", 16), 0, 0, 0]


def test_bins():
    assert bins.bins_for(3) == [(0, 1), (1, 2), (2, 3)]
    assert len(bins.linear(403)) == 200 and bins.linear(403)[-1] == (400, 403) and bins.linear(403)[0] == (0, 2)
    grown = bins.growing(10_000)
    assert grown[0][0] == 0 and all(b - a >= 5 for a, b in grown) and grown[-1][1] >= 10_000 > grown[-1][0]
    assert [a for a, _ in grown[1:]] == [b for _, b in grown[:-1]]
    assert bins.label(0, 1) == "1" and bins.label(1, 3) == "2-3"


def test_bin_index(spark):
    stops = [b for _, b in bins.growing(5000)]
    got = {r.p: r.b for r in spark.range(5000).select(F.col("id").alias("p"), bins.bin_index(F.col("id"), stops).alias("b")).collect()}
    assert got == {p: next(i for i, s in enumerate(stops) if p < s) for p in range(5000)}


def test_clock(spark):
    assert values(spark, [(3725,), (359999,)], "s long", C.clock(F.col("s"))) == [("01:02",), ("99:59",)]


def test_sql_functions(spark):
    from seqlume.functions.sql import register

    register(spark)
    row = spark.sql("SELECT seq_revcomp('aacN') a, seq_canonical('TTT') b, phred_error(10) c, phred_bin(60) d, seq_identity('XXACGTX', 'ACGT') e, read_scores('II').phred f").first()
    assert (row.a, row.b, row.d, row.e, row.f) == ("NGTT", "AAA", 11, 1.0, 40) and row.c == pytest.approx(0.1)
    assert [r.fragment for r in spark.sql("SELECT * FROM fragments('AACCGGTTTTGGCCAA', 3, 1, 1)").collect()] == ["AAC", "CAA"]
    spark.createDataFrame([(1, "AACCGGTTTTGGCCAA"), (2, None), (3, "AC"), (4, "aacNNNcca")], "i int, s string").createOrReplaceTempView("some_reads")
    got = [tuple(r) for r in spark.sql("SELECT i, f.at, f.fragment FROM some_reads, LATERAL fragments(s, 3, -1, -1) f ORDER BY i, at").collect()]
    assert got == [(1, 0, "AAC"), (1, 3, "CCG"), (1, 6, "AAA"), (1, 7, "AAA"), (1, 10, "GCC"), (1, 13, "CAA"), (4, 0, "AAC"), (4, 6, "CCA")]
