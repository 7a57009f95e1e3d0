import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leadloom.functions.ordering import json_key
from leadloom.operators import dml, integrity, lifecycle, writer
from leadloom.sources import warehouse
from leadloom.sources.registry import tables

def at(*when):
    return F.lit(str(datetime.datetime(*when))).cast("timestamp")


def metrics(spark, *dimensions):
    rows = spark.createDataFrame([(datetime.date(2024, 1, 1), "m", Decimal("1.00"), d) for d in dimensions], "metric_date date, metric_name string, value decimal(14,2), d string")
    return rows.withColumn("dimension", F.parse_json("d")).drop("d")


def none(spark, name):
    return spark.createDataFrame([], warehouse.described(tables()[name]))


def test_any_json_has_one_text(spark):
    texts = ['{"bb": 1, "a": {"y": [1, 2.50, "q\\"\\u0001é"], "x": null}}', '{ "a":{"x":null,"y":[1,2.50,"q\\"\\u0001é"]},"bb":1}', "[]", "1e2", "true", '"s"', "-0.0", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(json_key(F.col("t"))).collect()]
    one = '{"a": {"x": null, "y": [1, 2.50, "q\\"\\u0001é"]}, "bb": 1}'
    assert got == [one, one, "[]", "100", "true", '"s"', "0.0", None]
    assert json.loads(one) == json.loads(texts[0])


def test_generated_key_of_the_declared_type_bites(spark, tmp_path):
    rows = metrics(spark, '{"a": 1, "b": [2]}', '{"b": [2], "a": 1}', '{"a": "1"}', "{}")
    state = writer.inserted("metrics", none(spark, "metrics"), rows, now=at(2024, 5, 1, 12))
    assert sorted(r["dimension_key"] for r in state.collect()) == sorted(['{"a": 1, "b": [2]}'] * 2 + ['{"a": "1"}', "{}"])
    with pytest.raises(writer.Refused) as e:
        writer.write("metrics", state, f"file://{tmp_path}/m")
    assert e.value.broken == {"u_metrics_date_name_dim": 1}
    once = writer.inserted("metrics", none(spark, "metrics"), rows, ["metric_date", "metric_name", "dimension_key"], at(2024, 5, 1, 12))
    assert writer.write("metrics", once, f"file://{tmp_path}/n").count() == 3
    with pytest.raises(ValueError, match="generated"):
        writer.inserted("metrics", none(spark, "metrics"), rows.withColumn("dimension_key", F.lit("x")))
    with pytest.raises(ValueError, match="generated"):
        dml.with_dimension_key(rows.withColumn("dimension_key", F.lit("x")))


def test_a_key_is_made_once_for_each_text(spark):
    """Equal texts are one row where the key is made, rows without JSON have none, and what a conflict looks for makes no key again."""
    rows = metrics(spark, *['{"a": 1, "b": [2]}'] * 3, '{"b": [2.0], "a": 1}', "{}", None)
    keyed = dml.with_dimension_key(rows)
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    before, _, made = plan.partition("Aggregate [_of")
    assert "from_json" in made and "from_json" not in before
    assert sorted(str(r["dimension_key"]) for r in keyed.collect()) == sorted(['{"a": 1, "b": [2]}'] * 4 + ["{}", "None"])
    state = writer.inserted("metrics", none(spark, "metrics"), rows.where("dimension is not null"), ["metric_date", "metric_name", "dimension_key"])
    assert "from_json" not in state._jdf.queryExecution().optimizedPlan().toString() and state.count() == 2


def test_control_characters_of_flat_keys(spark):
    rows = spark.createDataFrame([({"k": "a\x01\tb"},)], "dimension map<string,string>")
    assert dml.with_dimension_key(rows).first()["dimension_key"] == '{"k": "a\\u0001\\tb"}'


def test_equal_rows_have_different_ids_and_runs_the_same(spark):
    rows = spark.createDataFrame([("x", "i", "s")] * 3, "business_name string, industry string, source string")
    ids = [sorted(r["id"] for r in dml.with_defaults("businesses", rows).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 3


def test_update_touches_changed_rows_alone(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "name string").withColumn("type", F.lit("DEMO"))
    old = warehouse.stored(writer.inserted("templates", none(spark, "templates"), rows, now=at(2024, 1, 1)), "templates")
    changes = old.where("name = 'a'").select("id", F.lit(2).alias("version"))
    new = {r["name"]: r for r in writer.updated("templates", old, changes, at(2024, 5, 1, 12)).collect()}
    assert (new["a"]["version"], new["b"]["version"]) == (2, 1)
    assert new["a"]["updated_at"] == datetime.datetime(2024, 5, 1, 12) and new["b"]["updated_at"] == datetime.datetime(2024, 1, 1)
    with pytest.raises(ValueError, match="twice"):
        writer.updated("templates", old, changes.union(changes))
    with pytest.raises(ValueError, match="no columns"):
        writer.updated("templates", old, changes.withColumnRenamed("version", "odd"))


def test_logs_take_new_rows_only(spark, tmp_path):
    root = f"file://{tmp_path}/model"
    warehouse.create(spark, root, ["audit_logs"])
    entry = spark.createDataFrame([("USER", "made", "task", "t1")] * 2, "actor_type string, action string, entity_type string, entity_id string")
    writer.append("audit_logs", entry, root, now=at(2024, 5, 1, 12))
    there = warehouse.read(spark, root, "audit_logs")
    assert there.count() == 2
    with pytest.raises(ValueError, match="append-only"):
        writer.updated("audit_logs", there, there.select("id", F.lit("x").alias("action")))
    with pytest.raises(writer.Refused, match="pkey"):
        writer.append("audit_logs", entry.withColumn("id", F.lit(there.first()["id"])).limit(1), root, now=at(2024, 5, 1, 12))
    with pytest.raises(writer.Refused, match="domain"):
        writer.append("audit_logs", entry.withColumn("actor_type", F.lit("ROBOT")), root, now=at(2024, 5, 1, 12))
    assert warehouse.read(spark, root, "audit_logs").count() == 2


def test_validation_scans_once_for_nulls_checks_and_domains(spark, tmp_path):
    spark.createDataFrame([], warehouse.described(tables()["lead_scores"])).write.parquet(f"{tmp_path}/x")
    plan = integrity.validate("lead_scores", spark.read.parquet(f"{tmp_path}/x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # the one pass, and the primary key


def test_an_upsert_shuffles_no_old_row(spark, tmp_path):
    """Old rows pass through; what meets the batch of the old part is its keys, without a shuffle if the batch is small."""
    for name in ("a", "b"):
        spark.range(10).selectExpr("id AS k", "id AS v").write.parquet(f"{tmp_path}/{name}")
    old, new = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("a", "b"))
    plan = dml.insert_or_ignore(old, new, ["k"])._jdf.queryExecution().executedPlan().toString()
    passed, met = plan[plan.index("Union") :].split("FileScan")[1:][:1], [part for part in plan.split("FileScan") if f"{tmp_path}/a" in part][1:]
    assert "ReadSchema: struct<k:bigint,v:bigint>" in passed[0] and all("ReadSchema: struct<k:bigint>" in part.split("\n")[0] for part in met)
    assert "Exchange" not in plan[plan.index("Union") :].split("FileScan")[0] and "BroadcastHashJoin" in plan


def test_business_hours_follow_the_zone(spark):
    rules = {"timezone": "America/Chicago", "workdays": [1, 2, 3, 4, 5], "start": "09:30", "end": "17:00"}
    times = ["2024-07-01 14:29:00", "2024-07-01 14:30:00", "2024-07-01 21:59:00", "2024-07-01 22:00:00", "2024-01-08 15:29:00", "2024-01-08 15:30:00", "2024-07-07 16:00:00"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").coalesce(1).select(lifecycle.in_business_hours(F.col("t").cast("timestamp"), rules))
    assert [r[0] for r in rows.collect()] == [False, True, True, False, False, True, False]


def test_send_limits(spark):
    rows = [("d", k, "outreach", k // 2, k % 3) for k in range(30)] + [("d", 100 + k, "followup", 100 + k, None) for k in range(4)] + [("d", 200, "odd", 200, None)]
    df = spark.createDataFrame(rows, "day string, n int, kind string, contact int, campaign_id int")
    campaigns = spark.createDataFrame([(0, 2), (1, None)], "campaign_id int, daily_limit int")
    out = lifecycle.send_limits(df, {"outreach": 6, "followup": 3, "max_per_contact": 1}, campaigns, ["n"]).collect()
    assert sorted(r["n"] for r in out if r["kind"] == "outreach") == [0, 2, 4, 6, 8, 10]
    assert sorted((r["n"], r["slot"]) for r in out if r["kind"] == "followup") == [(100, 1), (101, 2), (102, 3)]
    assert len(out) == 9


def test_notifications(spark):
    rules = {"buying_intent": True, "critical_exceptions": True, "high_exceptions": False, "digest": "daily"}
    rows = [("CRITICAL", None), ("HIGH", None), (None, "INTERESTED"), (None, None), ("LOW", "OTHER")]
    out = spark.createDataFrame(rows, "p string, c string").coalesce(1).select(lifecycle.notified(F.col("p"), F.col("c"), rules)).collect()
    assert [r[0] for r in out] == ["now", "daily", "now", "daily", "daily"]
