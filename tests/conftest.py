import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def same_rows(query, sql, spark, duck, path=SMALL):
    """Compare a query's rows with its SQL's, columns by name, in any order."""
    df = query(spark, path)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    answer = duck.execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in answer.fetchall())
    assert got == want
