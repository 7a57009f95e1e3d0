from decimal import Decimal

from pyspark.sql import functions as F

from leadloom.functions.ordering import by_enum
from leadloom.functions.scoring import classes_of, lead_class, lead_priority, weight_sum
from leadloom.operators import lifecycle
from leadloom.sources import seed
from leadloom.sources.registry import ENUMS


def test_priority_and_classes(spark):
    r = spark.range(1).select(lead_priority(F.lit(40), F.lit(70), F.lit(Decimal("61.25")), seed.LEAD_PRIORITY).alias("p"), lead_priority(F.lit(None).cast("int"), F.lit(1), F.lit(1), seed.LEAD_PRIORITY).alias("n")).first()
    assert r["p"] == Decimal("64.19") and r["n"] is None
    bounds = spark.createDataFrame([(Decimal(x),) for x in ("80", "79.99", "65", "64.99", "50", "49.99")], "s decimal(5,2)")
    assert [x[0] for x in bounds.select(lead_class(F.col("s"))).collect()] == ["HIGH_PRIORITY", "SECONDARY", "SECONDARY", "REVIEW", "REVIEW", "REJECT"]

    moved = classes_of({"review_min": 10, "high_priority_min": 90, "secondary_min": 80})
    assert moved == (("HIGH_PRIORITY", 90), ("SECONDARY", 80), ("REVIEW", 10))
    assert [x[0] for x in bounds.select(lead_class(F.col("s"), moved)).collect()] == ["SECONDARY", "REVIEW", "REVIEW", "REVIEW", "REVIEW", "REVIEW"]


def test_weights(spark):
    got = {r["score_type"]: r["s"] for r in seed.scoring_versions(spark).select("score_type", weight_sum(F.col("weights")).alias("s")).collect()}
    assert got == {"WEBSITE_QUALITY": 100, "BUSINESS_OPPORTUNITY": 100, "LEAD_PRIORITY": 1}
    assert seed.settings(spark).count() == 17


def test_enum_order(spark):
    rows = spark.createDataFrame([(x,) for x in ("LEAD_PRIORITY", None, "BUSINESS_OPPORTUNITY", "WEBSITE_QUALITY")], "t string")
    assert [r[0] for r in rows.orderBy(by_enum(F.col("t"), ENUMS["scoring_type"])).collect()] == ["WEBSITE_QUALITY", "BUSINESS_OPPORTUNITY", "LEAD_PRIORITY", None]


def test_latest_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([("b", 1, "2024-01-01", "X"), ("b", 2, "2024-01-02", "Y"), ("b", 3, "2024-01-02", "Z")], "k string, id int, t string, s string").withColumn("t", F.to_timestamp("t"))
    assert [r["s"] for r in lifecycle.latest_per_key(rows, "k", "t", "id").collect()] == ["Y"]
