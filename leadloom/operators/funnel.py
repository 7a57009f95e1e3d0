"""The linked funnel: one entity's rows of several tables, folded in their order into how far it came."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task of a shuffle gets, about: tasks grow in number with the tables, not in size.
TASK_ROWS = 1 << 19


def tasks(rows: int) -> int:
    """Tasks that ``rows`` rows are dealt over."""
    return max(1, -(-rows // TASK_ROWS))


def _dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """By keys over as many tasks as ``rows`` rows take; without a number, as the session deals them."""
    return df if rows is None else df.repartition(tasks(rows), *keys)


def _daily(steps: Sequence[DataFrame], rows: int | None) -> DataFrame:
    """(key, step, day, cents) with equal days of an entity summed: what an entity holds is bounded by days, not by rows."""
    out = None
    for k, each in enumerate(steps, 1):
        own = each.select("key", F.lit(k).alias("step"), F.col("at").cast("date").alias("day"), F.coalesce(F.col("cents").cast("long"), F.lit(0)).alias("cents"))
        out = own if out is None else out.union(own)
    # Rows without an entity or a day link with nothing.
    linked = out.where("key is not null and day is not null")
    return _dealt(linked, rows, "key", "step", "day").groupBy("key", "step", "day").agg(F.sum("cents").alias("cents"))


def journeys(steps: Sequence[DataFrame], rows: int | None = None) -> DataFrame:
    """How far each entity came: key, reached (steps in order), days (the day of each reached step), cents (of the last step, from its day on).

    ``steps``: tables of (key, at, cents), the first step first.  A step is reached on its first day that is
    not before the day of the step before it; a step that is not reached ends the journey.  The tables'
    rows are summed by entity, step and day before they meet in one shuffle by entity.  ``rows``: how many the
    tables have together, about; a task then gets some ``TASK_ROWS`` of them, whatever the session's number of
    shuffle partitions.
    """
    listed = F.array_sort(F.collect_list(F.struct("day", "step", "cents")))
    start = F.struct(F.lit(0).alias("reached"), F.array().cast("array<date>").alias("days"), F.lit(0).cast("long").alias("cents"))
    last = F.lit(len(steps))

    def fold(found: Column, row: Column) -> Column:
        onward = row["step"] == found["reached"] + 1
        reached = F.when(onward, row["step"]).otherwise(found["reached"])
        days = F.when(onward, F.concat(found["days"], F.array(row["day"]))).otherwise(found["days"])
        cents = found["cents"] + F.when((reached == last) & (row["step"] == last), row["cents"]).otherwise(F.lit(0).cast("long"))
        return F.struct(reached.alias("reached"), days.alias("days"), cents.alias("cents"))

    folded = _dealt(_daily(steps, rows), rows, "key").groupBy("key").agg(F.aggregate(listed, start, fold).alias("j"))
    return folded.select("key", "j.reached", "j.days", "j.cents")


def linked_funnel(steps: Sequence[DataFrame], names: Sequence[str], rows: int | None = None) -> DataFrame:
    """By step of ``names``: step, stage, entities that reached it, per_mille of those at the step before, days_between (sum), cents paid (last step).

    ``rows``: as of ``journeys``.
    """
    found = journeys(steps, rows)
    # A row for each reached step and one for the step after, which counts those that reached the step before.
    at = F.explode(F.sequence(F.lit(1), F.col("reached") + 1))
    each = found.where("reached > 0").select(at.alias("step"), "reached", "days", "cents")
    here = F.col("step") <= F.col("reached")
    between = F.when(here & (F.col("step") > 1), F.date_diff(F.get("days", F.col("step") - 1), F.get("days", F.col("step") - 2)))
    sums = each.groupBy("step").agg(
        F.count_if(here).alias("entities"),
        F.count_if(F.col("step") > 1).alias("_before"),
        F.sum(between.cast("long")).alias("days_between"),
        F.sum(F.when(here & (F.col("step") == len(steps)), F.col("cents")).otherwise(0)).alias("cents"),
    )
    steps_ = found.sparkSession.createDataFrame([(k, n) for k, n in enumerate(names, 1)], "step int, stage string")
    # A row for each name, so a handful.
    full = steps_.join(sums, "step", "left").fillna(0, ["entities", "_before", "days_between", "cents"])
    per_mille = F.when(F.col("_before") > 0, F.floor(1000 * F.col("entities") / F.col("_before")).cast("long"))
    return full.select("step", "stage", "entities", per_mille.alias("per_mille"), "days_between", "cents")
