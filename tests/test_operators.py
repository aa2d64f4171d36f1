import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from seqlume.operators import adapters as A
from seqlume.operators import dedup, fragments, identify, nano, pairs, profile, reads
from seqlume.plans.skew import lookup, small

SCHEMA = "read_idx long, name string, sequence string, qualities string"


def make_reads(n=60, seed=1, longest=150):
    rnd = random.Random(seed)
    rows = [(0, "a", None, None), (1, "b", "", ""), (2, "c", "ACGT", "II"), (3, "d", "ACGT", "II\x7fI"), (4, "e", "acgtn", "IIIII")]
    for i in range(5, n):
        size = rnd.randint(0, longest)
        rows.append((i, f"r{i}", "".join(rnd.choice("ACGTNacgt") for _ in range(size)), "".join(chr(rnd.randint(33, 126)) for _ in range(size))))
    return rows


def usable(s, q):
    return q if q is not None and s is not None and len(q) == len(s) and all(33 <= ord(c) <= 126 for c in q) else ""


@pytest.mark.parametrize("end", [100, 3])
def test_profile_matches_brute_force(spark, end):
    rows = make_reads()
    want = collections.Counter()
    for i, _, s, q in rows:
        for kind, text, code in (("base", s or "", lambda c: "ACGTN".index(c.upper()) if c.upper() in "ACGT" else 4), ("phred", usable(s, q), lambda c: min(ord(c) - 33, 47) >> 2)):
            for p, c in enumerate(text):
                want[kind, i % 2, p, code(c)] += 1
                if p >= len(text) - end:
                    want["end_" + kind, i % 2, p - len(text) + end, code(c)] += 1
    df = spark.createDataFrame(rows, SCHEMA).withColumn("g", (F.col("read_idx") % 2).cast("int")).withColumn("pos", F.lit(7))
    got = {(r["kind"], r["g"], r["pos"], r["code"]): r["n"] for r in profile.profile(df, ["g"], end).collect()}
    assert got == dict(want)


def test_profile_handles_long_reads_and_other_alphabets(spark, monkeypatch):
    rows = [(0, "x", "ACGT" * 50_000, "I" * 200_000), (1, "y", "AéC", "III")]
    got = {(r["kind"], r["pos"], r["code"]): r["n"] for r in profile.profile(spark.createDataFrame(rows, SCHEMA)).where("pos < 4").collect()}
    assert got["base", 0, 0] == 2 and got["base", 1, 4] == 1 and got["base", 1, 1] == 1 and got["base", 2, 1] == 1 and got["phred", 2, 10] == 2


def test_profile_of_nothing(spark):
    assert profile.profile(spark.createDataFrame([], SCHEMA)).count() == 0
    assert profile.quality_spread(profile.binned(profile.profile(spark.createDataFrame([], SCHEMA)), "phred", []), []).count() == 0


def test_scores_are_exact(spark):
    rows = [("I" * n,) for n in (1, 33, 100, 150, 151)] + [("5" * 150,), ("!",), ("",), (None,), ("~" * 7,), ("I" * 3 + "#" * 50,)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string").coalesce(1).select(reads.scores("q")).collect()]
    assert [g.phred for g in got[:7]] == [40] * 5 + [20, 0]
    assert got[7].phred is None and got[8].phred is None and got[9].phred == 93
    mean = (3 * 10**-4 + 50 * 10**-0.2) / 53
    assert got[10].phred == math.floor(-10 * math.log10(mean)) and got[10].q20 == 3


def test_summary_of_nothing_and_of_empty_reads(spark):
    empty = spark.createDataFrame([], SCHEMA)
    row = reads.summary(reads.facts(empty, []), []).first()
    assert row.total_reads == 0 and row.mean_length == 0 and row.minimum_length == 0 and row.total_bases == 0
    one = reads.summary(reads.facts(spark.createDataFrame([(0, "x", None, None)], SCHEMA), []), []).first()
    assert one.total_reads == 1 and one.maximum_length == 0


def test_lengths(spark):
    rnd = random.Random(3)
    for _ in range(3):
        sizes = [rnd.choice([0, 3, 7, 50, 51, rnd.randint(1, 400)]) for _ in range(rnd.randint(1, 80))]
        df = spark.createDataFrame([(i, "x", "A" * n, "I" * n) for i, n in enumerate(sizes)], SCHEMA)
        counts = reads.lengths(reads.facts(df, []), [])
        ordered = sorted(sizes)
        row = reads.length_percentiles(counts, []).first()
        assert [row[f"q{p}"] for p in reads.PERCENTILES] == [ordered[int(p * len(sizes) / 100)] for p in reads.PERCENTILES]
        total, so_far, n50 = sum(sizes), 0, 0
        for n in ordered:
            so_far += n
            if total // 2 > 0 and so_far >= total // 2:
                n50 = n
                break
        assert reads.n50_n90(counts, []).first().n50 == n50
        assert sum(r.n for r in reads.length_distribution(counts, []).collect()) == len(sizes)


def test_quality_spread(spark):
    counts = spark.createDataFrame([(0, 2, 30), (0, 7, 50), (0, 11, 20), (1, 3, 1)], "bin int, code int, n long")
    got = {(r.bin, r.series): r.phred for r in profile.quality_spread(counts, []).collect()}
    e = profile.BIN_ERRORS
    assert got[0, "bottom 50"] == pytest.approx(-10 * math.log10((30 * e[2] + 20 * e[7]) / 50), abs=1e-4)
    assert got[0, "top 10"] == pytest.approx(-10 * math.log10(e[11]), abs=1e-4)
    assert got[1, "bottom 50"] == 0 and got[1, "mean"] == pytest.approx(-10 * math.log10(e[3]), abs=1e-4)


def test_adapters(spark):
    listed = [("one", "GATT", "end"), ("two", "TACA", "start")]
    df = spark.createDataFrame([(0, "x", "gattaca", ""), (1, "x", "GATTGATT", ""), (2, "x", "CCCC", ""), (3, "x", None, None)], SCHEMA)
    got = {(r.adapter, r.pos, r.back): r.n for r in A.hit_counts(A.hits(df, listed, []), []).collect()}
    assert got == {("GATT", 0, 6): 1, ("GATT", 0, 7): 1, ("TACA", 3, 3): 1}
    curve = A.curve(A.hit_counts(A.hits(df, listed, []), []), df.agg(F.count("*").alias("reads")), listed, [], 8)
    rows = {(r.adapter, r.bin): r.percent for r in curve.collect()}
    assert rows["GATT", 7] == 50 and rows["TACA", 0] == 25 and rows["TACA", 4] == 0 and len(rows) == 16
    assert A.hits(df, [], []).count() == 0
    with pytest.raises(ValueError, match="position"):
        A.listed(spark.createDataFrame([("n", "all", "ACGT", "middle")], "name string, sequencing_technology string, sequence string, sequence_position string"))


def test_tiles(spark):
    rows = [(i, f"a:b:c:d:{i % 3}:x:y", "ACGT", "IIII" if i % 3 else "!!!!") for i in range(30)] + [(99, "bad", "AC", "II")]
    errors = profile.tile_errors(spark.createDataFrame(rows, SCHEMA), F.expr("cast(nullif(regexp_extract(name, ':([0-9]):x', 1), '') as long)"))
    assert errors.count() == 12
    flags = {r.tile: r.errors for r in profile.flagged_tiles(profile.tile_deviation(errors, []), []).collect()}
    assert flags == {0: "10x"}


def test_overrepresented(spark):
    rows = [(i, "x", "A" * 31 if i % 4 == 0 else "ACGTACGTAGCTAGCTGATCGATGCATGCAC", "") for i in range(100)]
    lists = fragments.fragment_lists(fragments.sampled(spark.createDataFrame(rows, SCHEMA), 1), [], 31)
    counts, totals = fragments.fragment_counts(lists, []), fragments.fragment_totals(lists, [])
    assert totals.first().sampled == 100
    assert [r.n for r in fragments.overrepresented(counts, totals, [], 0.5, 1).collect()] == [75]
    assert fragments.overrepresented(counts, totals, [], 0.5, 1, most=20).count() == 2
    for bad in ({"fraction": 2}, {"least": 0}, {"most": 0}):
        with pytest.raises(ValueError):
            fragments.overrepresented(counts, totals, [], **bad)
    with pytest.raises(ValueError):
        fragments.fragment_lists(spark.createDataFrame(rows, SCHEMA), [], 4)


@pytest.mark.parametrize("every", [1, 3, 7, 20])
def test_sampling(spark, every):
    assert fragments.sampled(spark.range(1000).withColumnRenamed("id", "read_idx"), every).count() == math.ceil(1000 / every)


def test_sampling_of_each_mate(spark, monkeypatch):
    monkeypatch.setattr(fragments, "RANGE", 37)
    rows = [(i, 1 + i % 2) for i in range(1000) if i % 7] + [(None, 1)]
    df = spark.createDataFrame(rows, "read_idx long, mate int")
    got = {(r.read_idx, r.mate) for r in fragments.sampled(df, 8, by=["mate"]).collect()}
    assert got == {x for m in (1, 2) for x in sorted(r for r in rows if r[0] is not None and r[1] == m)[::8]}


def test_first_come_of_each_mate(spark):
    rows = [(i, 1 + i % 2, ("A" if i < 2 else "C") * 21) for i in range(6)]
    df = spark.createDataFrame(rows, "read_idx long, mate int, sequence string")
    assert {tuple(r) for r in fragments.first_come(df, 1, by=["mate"]).collect()} == {(1, "A" * 21, 1), (2, "A" * 21, 1)}


def test_subsample_keeps_the_smallest_number_of_bits(spark):
    counts = spark.range(10_000).select(F.col("id").cast("string").alias("bases"), F.lit(0).alias("length_class"), F.lit(1).alias("n"))
    kept, bits = dedup.subsampled(counts, 179)
    hashes = [r.h for r in counts.select(F.xxhash64("bases", "length_class").alias("h")).collect()]
    assert kept.count() == sum(h & ((1 << bits) - 1) == 0 for h in hashes) <= 179 < sum(h & ((1 << bits - 1) - 1) == 0 for h in hashes)


def test_duplication(spark):
    counts = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("c", 0, 7), ("d", 0, 60000)], "bases string, length_class int, n long")
    histogram = dedup.duplication_histogram(counts, [])
    assert {r.times: r.fingerprints for r in histogram.collect()} == {1: 2, 7: 1, 60000: 1}
    shares = {r.bucket: r.reads for r in dedup.duplication_buckets(histogram, []).collect()}
    assert shares["1"] == 2 and shares["6-10"] == 7 and shares["> 50000"] == 60000 and len(shares) == 16


def brute_insert(s1, s2):
    comp = {"A": "T", "C": "G", "G": "C", "T": "A"}
    s1 = s1.upper()
    rc = lambda x: [comp.get(c) for c in reversed(x.upper())]
    if min(len(s1), len(s2)) < 16:
        return 0
    a, b = rc(s2[:16]), rc(s2[-16:])
    for i in range(len(s1) - 15):
        for needle, size in ((a, 16), (b, len(s2))):
            if sum(x != y for x, y in zip(s1[i : i + 16], needle, strict=True)) <= 1:
                return i + size
    return 0


def test_insert_sizes(spark):
    rnd = random.Random(7)
    rows = [("ATATATATATATATAT", "ATATATATATATATAT"), ("A" * 15, "T" * 20), ("", ""), ("N" * 40, "N" * 40), ("NNNNNNNNNNATATATATATATATAT", "ATATATATATATATATNNNNNNNNNN")]
    for _ in range(300):
        core = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(10, 90)))
        rc = core[::-1].translate(str.maketrans("ACGT", "TGCA"))
        tail = lambda: "".join(rnd.choice("ACGTN") for _ in range(rnd.randint(0, 40)))
        a, b = list((core + tail())[:100]), list((rc + tail())[:100].lower())
        for s in (a, b):
            for _ in range(rnd.randint(0, 3)):
                s[rnd.randrange(len(s))] = rnd.choice("ACGTN")
        rows.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", pairs.insert_size("a", "b").alias("i")).collect()
    assert [(r.a, r.b, r.i) for r in got] == [(a, b, brute_insert(a, b)) for a, b in rows]


def test_overlap_adapters(spark):
    sized = spark.createDataFrame([("AAAACC", "GGGGTT", 4), ("AAAACC", "GGGG", 4), ("AA", "GG", 0)], "sequence1 string, sequence2 string, insert int")
    found = pairs.overlap_adapters(sized, [])
    assert {(r.mate, r.adapter): r.n for r in found.collect()} == {(1, "CC"): 2, (2, "TT"): 1}
    assert [(r.mate, r.length, r.adapter, r.n) for r in pairs.top_by_length(found, []).orderBy("mate").collect()] == [(1, 2, "CC", 2), (2, 2, "TT", 1)]


@pytest.mark.parametrize("second,problem", [([(0, "r/2", "A", "I")], {"read 1 only": 1, None: 1}), ([(0, "r/2", "A", "I"), (1, "x/2", "A", "I"), (2, "q", "A", "I")], {None: 1, "names differ": 1, "read 2 only": 1})])
def test_zipped(spark, second, problem):
    first = spark.createDataFrame([(0, "r/1", "A", "I"), (1, "s/1", "A", "I")], SCHEMA)
    got = pairs.zipped(first, spark.createDataFrame(second, SCHEMA)).groupBy("problem").count().collect()
    assert {r.problem: r["count"] for r in got} == problem


@pytest.mark.parametrize("target,query,expected", [
    ("XXXACGTXXX", "ACGT", 4), ("ACGT", "ACGT", 4), ("ACXGT", "ACGT", 3), ("ACGT", "ACXGT", 4), ("ACGT", "AGGT", 3), ("XXACXGTXXXACGTXXXX", "ACGT", 4), ("TGTTACGG", "GGTTGACTA", 5),
    ("AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGACGGAAGCAAGCGTCTGAACTCCCCAGCA", 23), ("", "ACGT", 0), ("ACGT", "", 0),
])
def test_local_alignment(spark, target, query, expected):
    got = spark.createDataFrame([(target, query), ("ACGTACGTAC", "ACGTA")], "t string, q string").select(identify.sequence_identity("t", "q")).collect()
    assert got[0][0] == pytest.approx(expected / max(len(query), 1)) and got[1][0] == 1.0


def test_identified(spark):
    library = spark.createDataFrame([("long", "T" * 30 + "ACGTTGCAAGCTAGCTTAGCA" + "C" * 30), ("short", "ACGTTGCAAGCTAGCTTAGCA"), ("other", "G" * 40)], "name string, sequence string")
    queries = spark.createDataFrame([("ACGTTGCAAGCTAGCTTAGCA",), ("TGCTAAGCTAGCTTGCAACGT",), ("ATATATATATATATATATATA",), (None,)], "query string")
    got = {r.query: (r.matches, r.name) for r in identify.identified(queries, library).collect()}
    assert got == {"ACGTTGCAAGCTAGCTTAGCA": (21, "short"), "TGCTAAGCTAGCTTGCAACGT": (21, "short"), "ATATATATATATATATATATA": (0, "No match")}


def test_nano(spark):
    name = "35eb0273-89e2-4093-98ed-d81cbdafcac7 ch=5 start_time=2020-01-01T00:00:00Z"
    rows = [(0, name, "ACGT", "IIII", None, None, 2.0, None), (0, name, "ACGT", "IIII", None, None, 2.0, None), (1, "x", "A" * 900, "I" * 900, 7, 1577836800 + 7200, 1.0, "35eb0273-89e2-4093-98ed-d81cbdafcac7"), (2, "y", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", channel int, t long, duration float, parent_id string").withColumn("start_time", F.timestamp_seconds("t"))
    facts = nano.nano_facts(df, [])
    assert {r.channel: r.bases for r in nano.channels(facts, []).collect()} == {5: 4, 7: 900, -1: 0}
    slots = nano.time_slots(facts, []).orderBy("slot").collect()
    assert len(slots) == 121 and slots[0].reads == 1 and slots[120].bases == 900 and slots[1].reads == 0
    assert {r.slot: r.n for r in nano.translocation(facts, []).collect()} == {0: 1, 80: 1}
    assert nano.split_reads(facts, []).first().with_parent == 1


def test_lookup_spreads_hot_keys(spark):
    probe = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    unique = probe.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    for how, rows in (("inner", 13_333), ("left", 20_000), ("left_semi", 13_333)):
        wide = lookup(probe, unique, ["k"], how, weight="n", broadcast_rows=10)
        narrow = lookup(probe, unique, ["k"], how, weight="n")
        assert wide.count() == narrow.count() and sorted(wide.columns) == sorted(narrow.columns)
        assert sorted(map(str, wide.select(*sorted(wide.columns)).collect())) == sorted(map(str, narrow.select(*sorted(narrow.columns)).collect()))
        assert abs(wide.count() - rows) <= 1


def test_small_counts_rows_and_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, ["y" * 10], None)] * 10, "a string, b array<string>, c struct<d: int>")
    assert small(df) and small(df, 10) and not small(df, 9) and not small(df, 10, 9_000) and small(df, 10, 20_000)
    assert small(df.where("false"), 0)
