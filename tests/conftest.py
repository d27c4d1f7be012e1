import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    """Rows of a pandas frame as comparable tuples, columns by name."""
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, float):  # integers with nulls come as floats
            return str(int(v)) if v.is_integer() else repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).values.tolist())


@pytest.fixture
def same():
    def check(df, con, sql):
        a, b = df.toPandas(), con.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check
