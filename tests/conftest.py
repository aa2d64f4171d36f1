import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle(data):
    """Rows and columns of a SQL twin in DuckDB."""
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(df, con, sql):
    """Compare a DataFrame with SQL, order aside and floats to 5 places."""

    def plain(v):
        if isinstance(v, float):
            return round(v, 5)
        if hasattr(v, "isoformat"):
            return v.isoformat()[:19]
        return v

    cols = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    theirs = [tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)
