"""One Spark session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(rows):
    """Rows as sorted tuples of text; whole floats and ints compare alike."""

    def one(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(round(v, 9))
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def same(df, c, sql):
    """Whether a Spark result and a DuckDB query have the same rows, columns by name."""
    cols = sorted(df.columns)
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    order = [names.index(k) for k in cols]
    want = plain([[r[i] for i in order] for r in got.fetchall()])
    assert plain(df.select(*cols).collect()) == want
