import datetime
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leadloom.operators import delta, dml, integrity, writer
from leadloom.operators.integrity import Rules
from leadloom.sources import warehouse
from tests.conftest import SF

KEYS = ("l_orderkey", "l_linenumber")


@pytest.fixture(scope="module")
def parts(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    old = warehouse.stored(delta.first_of_each(lines.where("l_orderkey % 2 = 0"), KEYS).repartitionByRange(6, "l_orderkey").sortWithinPartitions("l_orderkey"), "old")
    return old, lines


def scans(df):
    """The columns that each scan of a plan reads."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"Location: \S+ \[([^\]]*)\].*?ReadSchema: struct<([^>]*)>", plan, re.S)


def test_delta_equals_whole_validation(parts):
    old, lines = parts
    batch = lines.where("l_orderkey % 2 = 1 OR l_orderkey % 10 = 0").withColumn("l_quantity", F.expr("if(l_linenumber = 3, null, l_quantity)"))
    rules = Rules({"quantity": F.col("l_quantity").isNull()}, {"line": KEYS, "part": ("l_partkey", "l_orderkey", "l_linenumber")}, {})
    old = old.where("l_quantity is not null")
    got = {tuple(r) for r in delta.delta_violations(old, batch, rules).collect()}
    whole = {tuple(r) for r in integrity.violations(old.unionByName(batch.select(*old.columns)), rules).collect()}
    assert got == whole and {n for n, _ in got} == {"quantity", "line", "part"}


def test_old_rows_are_read_by_key_only(parts):
    old, lines = parts
    folder = old.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    batch = warehouse.stored(lines.where("l_orderkey between 40 and 60"), "batch")
    for df in (delta.new_rows(old, batch, KEYS), delta.key_violations(old, batch, KEYS)):
        read = [columns for place, columns in scans(df) if folder in place]
        assert read and all(set(re.findall(r"(\w+):", c)) == set(KEYS) for c in read)
        assert "GreaterThanOrEqual(l_orderkey,40)" in df._jdf.queryExecution().executedPlan().toString()


def test_insert_or_ignore_moves_no_old_row(parts):
    old, lines = parts
    plan = dml.insert_or_ignore(old, lines, KEYS)._jdf.queryExecution().executedPlan().toString()
    union = plan[plan.index("Union") :]
    first = union[: union.index("Scan parquet") + 400]
    assert "Exchange" not in first and "l_tax" in first


def test_upsert_adds_once(spark, parts, tmp_path):
    old, lines = parts
    path = f"file://{tmp_path}/lines"
    assert delta.upsert(spark, path, lines.where("l_orderkey % 4 = 0"), KEYS) > 0
    before = warehouse.files(spark, path)
    added = delta.upsert(spark, path, lines, KEYS)
    after = warehouse.files(spark, path)
    assert added > 0 and set(before) < set(after)
    assert delta.upsert(spark, path, lines, KEYS) == 0 and warehouse.files(spark, path) == after
    assert spark.read.option("recursiveFileLookup", True).parquet(path).count() == lines.select(*KEYS).distinct().count()


def test_null_keys_and_other_types(spark):
    old = spark.createDataFrame([(1, "a", 1.5), (None, "b", 2.5)], "k int, s string, x double")
    batch = spark.createDataFrame([(1, "z", 9.0), (None, "c", 2.5), (None, "c", 2.5), (2, "d", 1.5), (2, "c", 7.0)], "k int, s string, x double")
    assert sorted(r["s"] for r in delta.new_rows(old, batch, ["k"]).collect()) == ["c", "c", "c"]
    assert sorted(r["s"] for r in delta.new_rows(old, batch, ["x"]).collect()) == ["c", "z"]
    assert delta.new_rows(old, batch.where("k is null"), ["k"]).count() == 2
    assert delta.new_rows(old, batch.where("false"), ["k"]).count() == 0
    assert [tuple(r) for r in delta.key_violations(old, batch, ["k"]).orderBy("k").collect()] == [(1,), (2,)]


def test_stored_tables_take_deltas(spark, tmp_path):
    root = f"file://{tmp_path}/model"
    warehouse.create(spark, root, ["metrics"])

    def rows(*days, value="1.00"):
        made = spark.createDataFrame([(datetime.date(2024, 1, d), "m", Decimal(value), "{}") for d in days], "metric_date date, metric_name string, value decimal(14,2), d string")
        return made.withColumn("dimension", F.parse_json("d")).drop("d")

    unique = ("metric_date", "metric_name", "dimension_key")
    assert writer.append("metrics", rows(1, 2), root) == 2
    with pytest.raises(writer.Refused) as e:
        writer.append("metrics", rows(2, 3, value="2.00"), root)
    assert e.value.broken == {"u_metrics_date_name_dim": 1}
    assert writer.upsert("metrics", rows(2, 3, 3), root, unique) == 1
    assert writer.upsert("metrics", rows(2, 3, 3), root, unique) == 0
    assert warehouse.read(spark, root, "metrics").count() == 3
    with pytest.raises(writer.Refused):
        writer.write("metrics", warehouse.read(spark, root, "metrics").union(warehouse.read(spark, root, "metrics")), f"{root}-2")
    assert warehouse.read(spark, f"{root}-2", "") is None
