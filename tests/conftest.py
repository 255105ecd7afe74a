import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    """A pandas frame's rows as sorted tuples of comparable values."""
    import decimal

    import pandas as pd

    def value(v):
        if v is None or pd.isna(v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, (bool, str)):
            return v
        if isinstance(v, (int, float, decimal.Decimal)):
            return round(float(v), 4)
        return str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(value(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        a, b = query(spark, SF).toPandas(), duck.execute(sql).fetchdf()
        assert sorted(a.columns) == sorted(b.columns)
        assert plain(a) == plain(b)
        return len(a)

    return check
