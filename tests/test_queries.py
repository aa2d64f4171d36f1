"""Every core query against its SQL twin on the smallest tables."""

import pytest
from conftest import same

from seqlume import oracles, queries

QUERIES, SQL = queries.queries(), oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, oracle, name):
    same(QUERIES[name](spark, data), oracle, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


@pytest.mark.parametrize("name", ["fingerprint_subsample", "fingerprint_subsample_parity"])
def test_stores_of_the_usual_size_keep_all(spark, name):
    larger = "/root/testdata/sf0.01"
    assert QUERIES[name](spark, larger).count() == QUERIES["fingerprint_counts"](spark, larger).count() > 1_000


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
