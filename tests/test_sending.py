import datetime as dt
import random
from collections import Counter
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from leadloom.operators import sending

HOURS = {"timezone": "America/Chicago", "workdays": [1, 2, 3, 4, 5], "start": "09:00", "end": "17:00"}
LIMITS = {"outreach": 3, "followup": 5}


def queue(rows, limits, last):
    """Day by day, first come first sent."""
    out, first = {}, min(r[1] for r in rows)
    for kind, limit in limits.items():
        waiting, day = [], first
        arrive = sorted((r for r in rows if r[0] == kind), key=lambda r: r[1:])
        while day <= last:
            waiting += [r for r in arrive if r[1] == day]
            for r in waiting[:limit]:
                out[r[2]] = day
            waiting, day = waiting[limit:], day + dt.timedelta(1)
    return {r[2]: out.get(r[2]) for r in rows}


def test_queue_equals_the_days_one_by_one(spark, many_parts):
    dice = random.Random(2)
    start = dt.date(2024, 2, 25)
    rows = [(dice.choice(["outreach"] * 4 + ["followup", "other", None]), start + dt.timedelta(dice.choice([0, 0, 0, 1, 2, 9, 9, 14])), k) for k in range(160)]
    last = dt.date(2024, 3, 20)
    df = spark.createDataFrame(rows, "kind string, day date, id long").repartition(3)
    got = {r["id"]: r["send_day"] for r in sending.carry_over(df, LIMITS, ["id"], str(last)).collect()}
    assert got == queue(rows, LIMITS, last) and None in got.values()
    assert max(Counter((r[0], got[r[2]]) for r in rows if got[r[2]]).values()) == 5
    assert sending.carry_over(df.where("false"), LIMITS, ["id"], str(last)).count() == 0


def test_backlog_is_the_recursion(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 12), ("a", dt.date(2024, 1, 2), 1), ("a", dt.date(2024, 1, 7), 4)], "kind string, day date, arrived long")
    got = [(r["day"].day, r["sent"], r["waiting"]) for r in sending.backlog(df, F.lit(3), "2024-01-09").orderBy("day").collect()]
    waiting, want = 0, []
    for day in range(1, 10):
        came = waiting + {1: 12, 2: 1, 7: 4}.get(day, 0)
        waiting = max(0, came - 3)
        want.append((day, came - waiting, waiting))
    assert got == want


def opening(at, zone, rules):
    """The next open instant, minute by minute of the days that follow."""
    local = at.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(zone))
    for k in range(15):
        day = local.date() + dt.timedelta(k)
        if day.isoweekday() in rules["workdays"]:
            low, high = (dt.datetime.combine(day, dt.time.fromisoformat(rules[c]), ZoneInfo(zone)).astimezone(dt.timezone.utc).replace(tzinfo=None) for c in ("start", "end"))
            if at < high:
                return max(at, low)
    return None


def test_next_open_follows_daylight_saving(spark):
    dice, rows = random.Random(1), []
    for month, day in ((3, 6), (11, 1), (3, 28), (12, 30)):
        rows += [(dt.datetime(2024, month, day) + dt.timedelta(minutes=dice.randint(0, 9 * 1440)), dice.choice(["America/Chicago", "Europe/Berlin", "Asia/Kolkata"])) for _ in range(120)]
    rows += [(dt.datetime(2024, 3, 8, 22, 59, 59), "America/Chicago"), (dt.datetime(2024, 3, 8, 23), "America/Chicago"), (dt.datetime(2024, 3, 11, 14), "America/Chicago")]
    df = spark.createDataFrame([(k, str(t), z) for k, (t, z) in enumerate(rows)], "k long, t string, z string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    for rules in (HOURS, HOURS | {"workdays": [6], "start": "00:30", "end": "01:00"}):
        found = sending.next_open(df, "t", rules, F.col("z")).select("k", F.col("open_at").cast("timestamp_ntz").alias("o")).collect()
        assert {r["k"]: r["o"] for r in found} == {k: opening(t, z, rules) for k, (t, z) in enumerate(rows)}


def test_next_open_of_nulls_and_no_workdays(spark):
    df = spark.createDataFrame([(1, None, "UTC"), (2, "2024-01-06 12:00:00", None)], "k int, t string, z string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r["open_at"] for r in sending.next_open(df, "t", HOURS, F.col("z")).collect()] == [None, None]
    assert sending.next_open(df, "t", HOURS).where("k = 2").first()["open_at"] is not None
    assert sending.next_open(df, "t", HOURS | {"workdays": []}).where("open_at is not null").count() == 0
    assert sending.next_open(df.where("false"), "t", HOURS).count() == 0


def test_the_calendar_is_met_by_a_hash_join(spark):
    df = spark.range(100).select(F.timestamp_micros(F.col("id") * 10**12).alias("t"))
    plan = sending.next_open(df, "t", HOURS)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
