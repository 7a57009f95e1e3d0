import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from leadloom.operators import entities, funnel, rollup
from leadloom.sources import warehouse

SCHEMA = "metric_date date, metric_name string, dimension_key string, value decimal(14,2)"


def batch(spark, *rows):
    return spark.createDataFrame([(dt.date(2024, 1, d), n, "{}", Decimal(v)) for d, n, v in rows], SCHEMA)


def state(spark, path):
    return {(r["metric_date"].day, r["metric_name"]): (r["value"], r["n"]) for r in rollup.read(spark, path).collect()}


def test_batches_and_untouched_days(spark, tmp_path):
    path = f"file://{tmp_path}/metrics"
    assert rollup.read(spark, path).count() == 0
    assert rollup.merge(spark, path, batch(spark, (1, "a", "1.10"), (1, "a", "2.20"), (2, "a", "5"), (3, "b", "1")), 1) == 3
    before = warehouse.files(spark, path)
    # A late row of day 1 and a new day; day 2 and day 3 keep their files.
    assert rollup.merge(spark, path, batch(spark, (1, "a", "10"), (1, "c", "7"), (9, "a", "1")), 2) == 2
    after = warehouse.files(spark, path)
    for day in (2, 3):
        assert [f for f in before if f"2024-01-0{day}" in f] == [f for f in after if f"2024-01-0{day}" in f] != []
    assert not {f for f in before if "2024-01-01" in f} & set(after)
    want = {(1, "a"): (Decimal("13.30"), 3), (1, "c"): (Decimal("7.00"), 1), (2, "a"): (Decimal("5.00"), 1), (3, "b"): (Decimal("1.00"), 1), (9, "a"): (Decimal("1.00"), 1)}
    assert state(spark, path) == want


def test_a_batch_counts_once(spark, tmp_path):
    path = f"file://{tmp_path}/metrics"
    rollup.merge(spark, path, batch(spark, (1, "a", "1")), 1)
    rollup.merge(spark, path, batch(spark, (1, "a", "1")), 2)  # as if batch 2 had stopped after day 1
    assert rollup.merge(spark, path, batch(spark, (1, "a", "1"), (2, "a", "4")), 2) == 1
    assert rollup.merge(spark, path, batch(spark, (1, "a", "1"), (2, "a", "4")), 2) == 0
    assert state(spark, path) == {(1, "a"): (Decimal("2.00"), 2), (2, "a"): (Decimal("4.00"), 1)}
    assert rollup.merge(spark, path, batch(spark, (1, "a", "1")).where("false"), 3) == 0
    with pytest.raises(ValueError, match="no date"):
        rollup.merge(spark, path, spark.createDataFrame([(None, "a", "{}", Decimal(1))], SCHEMA), 3)


def test_only_touched_folders_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/metrics"
    rollup.merge(spark, path, batch(spark, *((d, "a", "1") for d in range(1, 20))), 1)
    plan = rollup.read(spark, path).where(rollup.F.col("metric_date").isin([dt.date(2024, 1, 3)]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric_date" in plan or "PartitionFilters: [(metric_date" in plan


def journey(rows, n):
    """Steps one by one: the first day of each that is not before the day of the step before."""
    days = []
    for step in range(1, n + 1):
        later = sorted(d for s, d, _ in rows if s == step and (not days or d >= days[-1]))
        if not later:
            break
        days.append(later[0])
    return len(days), days, sum(c or 0 for s, d, c in rows if len(days) == n and s == n and d >= days[-1])


def test_journeys_equal_steps_one_by_one(spark):
    dice, rows = random.Random(6), []
    for _ in range(600):
        rows.append((dice.choice([0] * 8 + list(range(1, 60))), dice.choice([1, 1, 2, 2, 3, 4]), dt.date(2024, 1, dice.randint(1, 28)), dice.choice([None, 5, 70])))
    steps = [spark.createDataFrame([(k, d, c) for k, s, d, c in rows if s == step] + [(None, dt.date(2024, 1, 1), 9), (3, None, 9)], "key long, at date, cents long") for step in range(1, 5)]
    by = defaultdict(list)
    for k, *row in rows:
        by[k].append(tuple(row))
    want = {k: journey(own, 4) for k, own in by.items()}
    got = {r["key"]: (r["reached"], r["days"], r["cents"]) for r in funnel.journeys(steps).collect()}
    assert got == want and {n for n, _, _ in want.values()} == {0, 1, 2, 3, 4}
    out = {r["step"]: r for r in funnel.linked_funnel(steps, "abcd").collect()}
    reached = [sum(n >= k for n, _, _ in want.values()) for k in range(1, 5)]
    assert [out[k]["entities"] for k in range(1, 5)] == reached
    assert [out[k]["per_mille"] for k in range(1, 5)] == [None] + [1000 * b // a for a, b in zip(reached, reached[1:])]
    assert out[3]["days_between"] == sum((d[2] - d[1]).days for n, d, _ in want.values() if n >= 3) and out[4]["cents"] == sum(c for n, _, c in want.values() if n == 4)
    none = funnel.linked_funnel([s.where("false") for s in steps], "abcd").orderBy("step").collect()
    assert [tuple(r) for r in none] == [(k, n, 0, None, 0, 0) for k, n in enumerate("abcd", 1)]


def test_tasks_of_a_funnel_grow_in_number_not_in_size(spark, monkeypatch):
    """The number of rows deals them over tasks, more than the session has partitions, and each journey is folded once."""
    monkeypatch.setattr(funnel, "TASK_ROWS", 50)
    day = rollup.F.date_add(rollup.F.lit(dt.date(2024, 1, 1)), (rollup.F.col("id") % 9).cast("int")).alias("at")
    steps = [spark.range(n).select((rollup.F.col("id") % 90).alias("key"), day, rollup.F.lit(7).alias("cents")) for n in (400, 300, 300)]
    found = funnel.journeys(steps, 1000)
    assert found.rdd.getNumPartitions() == funnel.tasks(1000) == 20
    sizes = [r["count"] for r in found.groupBy(rollup.F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and sorted(map(str, found.collect())) == sorted(map(str, funnel.journeys(steps).collect()))
    out = funnel.linked_funnel(steps, "abc", 1000)
    assert sorted(out.collect()) == sorted(funnel.linked_funnel(steps, "abc").collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1


def test_entities_of_several_types(spark, many_parts):
    dice = random.Random(8)
    kinds = {"a": range(5), "b": range(3, 9)}
    rows = [(k, dice.choice(["a", "a", "b", "c", None]), dice.choice([4] * 6 + list(range(10)) + [None])) for k in range(500)]
    parents = {t: spark.createDataFrame([(i, f"{t}{i}") for i in ids], "id int, name string") for t, ids in kinds.items()}
    df = spark.createDataFrame(rows, "k long, entity_type string, entity_id long").repartition(3)
    want = {k: (t, i, i in kinds.get(t, ()), f"{t}{i}" if i in kinds.get(t, ()) else None) for k, t, i in rows}
    for hot in (20, 100_000):
        out = entities.dispatched(df, parents, hot)
        got = {r["k"]: (r["entity_type"], r["entity_id"], r["found"], r["name"]) for r in out.collect()}
        assert got == want and out.count() == len(rows)
    assert entities.dispatched(df.where("false"), parents).count() == 0


def test_a_hot_entity_is_dealt_over_tasks(spark, many_parts):
    df = spark.range(4000).select(rollup.F.col("id").alias("k"), rollup.F.lit("a").alias("entity_type"), rollup.F.lit(1).cast("long").alias("entity_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = entities.dispatched(df, {"a": spark.range(3).selectExpr("id", "'x' AS name")}, 100)
        sizes = [r["count"] for r in out.groupBy(rollup.F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and max(sizes) < 2500
