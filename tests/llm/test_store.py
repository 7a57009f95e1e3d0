import os

from leadloom.llm import store


def test_clear_removes_what_was_stored(spark):
    paths = [p.removeprefix("file://") for p in (store.stored(spark.range(3), "clear").inputFiles()[0],)]
    assert os.path.exists(paths[0])
    store.clear(spark)
    assert not os.path.exists(paths[0]) and store._WRITTEN == []


def test_few_keeps_large_tables(spark):
    df = spark.range(0, 100, 1, 8)
    assert store.few(df, 50).rdd.getNumPartitions() == 1 and store.few(df, 10**6).rdd.getNumPartitions() == 8
