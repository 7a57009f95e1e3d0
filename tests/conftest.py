import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4")
    session = builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def many_parts(spark):
    """Small ranges stay tasks of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(frame) -> list[tuple]:
    """Sorted rows of (columns, tuples), columns by name, numbers as floats."""
    columns, rows = frame
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return str(x)
        try:
            return str(round(float(x), 6))
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def same(df, relation) -> None:
    spark_rows = (df.columns, [tuple(r) for r in df.collect()])
    duck_rows = (relation.columns, relation.fetchall())
    assert sorted(spark_rows[0]) == sorted(duck_rows[0])
    assert rows_of(spark_rows) == rows_of(duck_rows)
