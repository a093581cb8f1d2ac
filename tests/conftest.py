import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import glob

    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, columns):
    """Rows as sorted tuples of text, numbers at four places, so that both engines' values compare."""
    import math

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.4f}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="session")
def same(spark, small, duck):
    """Check a registered query against its SQL."""

    def check(query, sql):
        got = [r.asDict() for r in query(spark, small).collect()]
        want = duck.sql(sql)
        want_rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
        columns = sorted(want.columns)
        assert not got or sorted(got[0]) == columns
        assert plain(got, columns) == plain(want_rows, columns)

    return check
