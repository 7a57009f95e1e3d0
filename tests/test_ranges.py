import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.operators import ranges


def rows(spark, kind):
    dice = random.Random(7)
    if kind == "one key":
        data = [("a", k, dice.choice(["x", "y", None])) for k in range(400)]
    elif kind == "nulls":
        data = [(None, k, dice.choice(["x", None])) for k in range(150)] + [("b", k, "z") for k in range(5)] + [("", k, "") for k in range(150)]
    else:
        data = [(dice.choice(["a"] * 6 + list("bcdefgh")), k, dice.choice(["x", "y", None])) for k in range(400)]
    dice.shuffle(data)
    return spark.createDataFrame(data, "key string, t long, v string").repartition(5)


@pytest.mark.parametrize("kind", ["one key", "nulls", "mixed"])
def test_equal_to_windows(spark, many_parts, kind):
    df = rows(spark, kind)
    assert ranges.parts(df, ["key"], ["t"]).select(ranges.PART).distinct().count() > 1
    by = Window.partitionBy("key").orderBy("t")
    want = df.select("key", "t", "v", F.row_number().over(by).alias("n"), F.lag("v").over(by).alias("before_v"), F.lead("v").over(by).alias("after_v"), F.lag("t").over(by).alias("before_t"))
    got = ranges.neighbours(ranges.numbered(df, ["key"], ["t"], "n"), ["key"], ["t"], ["v", "t"]).select("key", "t", "v", "n", "before_v", "after_v", "before_t")
    order = lambda r: (r["key"] is not None, r["key"] or "", r["t"])
    assert [tuple(r) for r in sorted(got.collect(), key=order)] == [tuple(r) for r in sorted(want.collect(), key=order)]


def test_a_key_in_all_rows_stays_in_many_tasks(spark, many_parts):
    """No window runs over the key alone: its rows are sorted by part."""
    df = ranges.numbered(rows(spark, "one key"), ["key"], ["t"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [row_number" in line]
    assert windows and all(ranges.PART in w[w.index("row_number") :] for w in windows)
    sizes = defaultdict(int)
    for r in ranges.parts(rows(spark, "one key"), ["key"], ["t"]).select(ranges.PART).collect():
        sizes[r[0]] += 1
    assert max(sizes.values()) < 300


def test_empty(spark):
    none = rows(spark, "mixed").where("false")
    assert ranges.numbered(none, ["key"], ["t"]).count() == 0 and ranges.neighbours(none, ["key"], ["t"], ["v"]).count() == 0
