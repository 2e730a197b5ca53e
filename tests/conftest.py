"""One Spark session for all tests."""

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def compare(spark):
    """compare(query, sql, sf_dir): the same rows by column name, whatever their order."""
    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    cell = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)

    def run(query, sql, sf_dir=SMALL):
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for t in tables:
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        want = want.fetchall()
        got = query(spark, sf_dir)
        assert sorted(got.columns) == sorted(names)
        order = sorted(names)
        mine = sorted(tuple(cell(r[c]) for c in order) for r in got.collect())
        theirs = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in want)
        assert mine == theirs

    return run
