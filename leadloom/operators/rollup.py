"""Daily metrics kept up to date by batches: mergeable sums, and only the days that a batch touches are written."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.warehouse import stored

KEYS = ("metric_date", "metric_name", "dimension_key")
_STATE = "metric_name string, dimension_key string, value decimal(24,2), n long, batch long, metric_date date"


def partial(rows: DataFrame) -> DataFrame:
    """``rows`` (metric_date, metric_name, dimension_key, value) summed by key: value and n merge by addition."""
    return rows.groupBy(*KEYS).agg(F.sum(F.col("value").cast("decimal(14,2)")).cast("decimal(24,2)").alias("value"), F.count("*").alias("n"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored sums by key: value, n and batch, the last batch that changed the day; none if there is no table yet."""
    try:
        return spark.read.schema(_STATE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STATE)


def merge(spark: SparkSession, path: str, rows: DataFrame, batch: int) -> int:
    """Add a batch of ``rows`` (metric_date, metric_name, dimension_key, value) to the table at ``path``; returns the days written.

    Batches are numbered upwards.  A day knows the last batch that changed it, so a batch that is run
    again, after a failure say, changes only days that it has not yet reached.  Late rows change their own day.
    Days are folders: those touched are read and written anew, all others keep their files.  Rows
    without a date are refused.
    """
    new = stored(partial(rows), "metrics-partial")
    days = [r["metric_date"] for r in new.select("metric_date").distinct().collect()]  # days, not rows: a few thousand at most
    if None in days:
        raise ValueError("a row has no date")
    if not days:
        return 0
    # Literal days prune the folders that are read.
    there = read(spark, path).where(F.col("metric_date").isin(days))
    done = there.groupBy("metric_date").agg(F.max("batch").alias("done")).where(F.col("done") >= batch).select("metric_date")
    fresh = new.join(F.broadcast(done), "metric_date", "left_anti")  # at most a row for each of the days
    kept = there.drop("batch").join(F.broadcast(fresh.select("metric_date").distinct()), "metric_date", "left_semi")
    summed = kept.unionByName(fresh).groupBy(*KEYS).agg(F.sum("value").cast("decimal(24,2)").alias("value"), F.sum("n").alias("n"))
    # Written aside first: the folders that it replaces are those it reads.
    state = stored(summed.withColumn("batch", F.lit(batch).cast("long")), "metrics-merged")
    n = state.select("metric_date").distinct().count()
    if n:
        by_day = state.repartition("metric_date", F.pmod(F.xxhash64(*KEYS), F.lit(4))).sortWithinPartitions(*KEYS)
        by_day.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("metric_date").parquet(path)
    return n
