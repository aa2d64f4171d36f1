"""The subpackage's queries against their SQL twins, or at least run."""

import pytest
from conftest import same

from seqlume.llm import oracles, queries

QUERIES, SQL = queries.queries(), oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, oracle, name):
    same(QUERIES[name](spark, data), oracle, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert rows or name in ("p8_reparameterised", "p5_disproved")


def test_distinct_counts_are_within_their_error(spark, data, oracle):
    exact = dict(oracle.execute("SELECT sample, count(DISTINCT upper(sequence)) FROM short_reads GROUP BY 1").fetchall())
    rows = [r for r in QUERIES["p2_distinct"](spark, data).collect() if r.grouping == "sample"]
    assert len(rows) == len(exact)
    for r in rows:
        assert abs(r.distinct - exact[r["sample"]]) <= max(0.51, 5 * r.error * exact[r["sample"]])


def test_reported_reads_stand_beside(spark, data):
    rows = QUERIES["p2_distinct"](spark, data).collect()
    assert any(r.total_reads for r in rows if r.grouping == "run_id,sample,mate")
    assert all(r.total_reads is None for r in rows if "day" in r.grouping)


def test_percentiles_of_lengths_are_within_their_error(spark, data):
    for r in QUERIES["p4_lengths"](spark, data).collect():
        assert r.median_rank_error <= r.stated_error_50 and r.n50_rank_error <= r.stated_error_50 and r.p99_rank_error <= r.stated_error_99
