import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leadloom.plans.operations import LINES_LAYOUT
from leadloom.sources import layout, warehouse
from leadloom.sources.registry import tables
from tests.conftest import SF


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('layout')}"
    lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    return root, layout.write(lines, f"{root}/lines", LINES_LAYOUT), layout.write(orders, f"{root}/orders", layout.Layout(bucket="o_orderkey"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_without_exchange(spark, laid):
    _, lines, orders = laid
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        assert "SortMergeJoin" in plan_of(joined) and "Exchange" not in plan_of(joined)
        assert joined.count() == spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def read_rows(df):
    """Rows that the scan of a plan gave."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while "Scan" not in node.nodeName():
        node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.children().head()
    return node.metrics().apply("numOutputRows").value(), node.metrics().apply("numFiles").value()


def test_lookups_skip_folders_buckets_and_row_groups(spark, laid):
    _, lines, _ = laid
    whole = spark.read.parquet(f"{SF}/lineitem.parquet")
    folder = lines.where("l_returnflag = 'R'")
    assert "PartitionFilters: [isnotnull(l_returnflag" in plan_of(folder) and folder.count() == whole.where("l_returnflag = 'R'").count()
    own = lines.where("l_orderkey = 33")
    assert "Bucketed" in plan_of(own) and read_rows(own)[0] < whole.count() / 4 and own.count() == whole.where("l_orderkey = 33").count()
    low, high = whole.agg(F.min("l_partkey"), F.max("l_partkey")).first()
    there = {r[0] for r in whole.select("l_partkey").distinct().collect()}
    absent = next((k for k in range(low, high) if k not in there), None)
    one = lines.where(F.col("l_partkey") == 5)
    assert "EqualTo(l_partkey,5)" in plan_of(one) and one.count() == whole.where("l_partkey = 5").count()
    if absent is not None:
        assert read_rows(lines.where(F.col("l_partkey") == absent))[0] == 0


def test_files_are_sorted_and_filtered(spark, laid):
    root, _, _ = laid
    for f in warehouse.files(spark, f"{root}/lines")[:5]:
        data = pq.read_table(f.removeprefix("file:")).select(["l_orderkey", "l_linenumber"]).to_pylist()
        keys = [(r["l_orderkey"], r["l_linenumber"]) for r in data]
        assert keys == sorted(keys)
    blooms = len(warehouse.files(spark, f"{root}/lines"))
    assert blooms <= 16 * 3


def test_declared_again(spark, laid):
    root, lines, orders = laid
    schema = ", ".join(f"`{c}` {t}" for c, t in lines.dtypes)
    again = layout.read(spark, f"{root}/lines", schema, LINES_LAYOUT)
    assert again.columns == lines.columns and sorted(map(tuple, again.collect())) == sorted(map(tuple, lines.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan_of(again.join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layouts_of_the_declared_indexes():
    found = {n: layout.layout_of(t) for n, t in tables().items()}
    assert found["lead_state_history"] == layout.Layout((), "business_id", 16, ("business_id", "created_at"), ("id",))
    assert found["outreach_messages"] == layout.Layout(("status",), "business_id", 16, ("business_id",), ("campaign_id", "contact_id", "id"))
    assert found["businesses"].folders == ("lifecycle_state",) and set(found["businesses"].bloom) == {"state", "city", "source", "industry", "zip"}
    assert found["system_settings"] == layout.Layout((), "key", 16, ("key",), ())


def test_any_declared_table_is_written(spark, tmp_path):
    for name in ("outreach_messages", "lead_state_history"):
        t = tables()[name]
        none = spark.createDataFrame([], warehouse.described(t))
        assert layout.write(none, f"file://{tmp_path}/{name}", layout.layout_of(t)).count() == 0
