"""Daily metrics by name and dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import canonical_key


def daily_rollup(rows: DataFrame, day: Column, name: Column, dimension: Column, value: Column) -> DataFrame:
    """(metric_date, metric_name, dimension_key, value, n): sums in decimals, so the order of rows does not matter."""
    keyed = rows.select(day.alias("metric_date"), name.alias("metric_name"), canonical_key(dimension).alias("dimension_key"), value.cast("decimal(14,2)").alias("v"))
    return keyed.groupBy("metric_date", "metric_name", "dimension_key").agg(F.sum("v").cast("decimal(24,2)").alias("value"), F.count("*").alias("n"))


def revenue_funnel(opportunities: DataFrame, customers: DataFrame, subscriptions: DataFrame, payments: DataFrame) -> DataFrame:
    """(step, stage, status, n, cents): rows and whole cents by status from opportunities to payments.

    Each table has (status, cents); cents may be null.  Every table is counted by itself, before the few sums meet.
    """
    out = None
    for step, (stage, rows) in enumerate({"opportunities": opportunities, "customers": customers, "subscriptions": subscriptions, "payments": payments}.items(), 1):
        sums = rows.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("cents").cast("long")), F.lit(0)).alias("cents"))
        sums = sums.select(F.lit(step).alias("step"), F.lit(stage).alias("stage"), "status", "n", "cents")
        out = sums if out is None else out.union(sums)
    return out
