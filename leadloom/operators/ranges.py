"""Ordered histories whose keys may hold any number of rows: sorted ranges, and what neighbours carry over.

A window by key sorts all rows of a key in one task.  Here rows are dealt by ranges of (key, order), so
that a large key lies in several tasks, and each part is numbered or looked at by itself.  A part then
gets what its first and last rows need from its neighbours: one or two rows for each part, however many
rows there are, so these edges are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.warehouse import stored

PART = "_part"


def parts(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` dealt by ranges of ``keys`` and ``order`` and written, with the number of their part, rising in that order."""
    return stored(rows.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], number: str = "number") -> DataFrame:
    """``rows`` with their number, from 1, among those of their keys in ``order``, as ``row_number`` gives it; ``order`` has no ties."""
    dealt = parts(rows, keys, order)
    local = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order)))
    counts = dealt.groupBy(PART, *keys).agg(F.count("*").alias("n")).select(PART, _key(keys).alias("key"), "n")
    # A key in several parts is the last of the first of them, the first of the last, and all of those between.
    edge = counts.groupBy(PART).agg(F.min_by(F.struct("key", "n"), "key").alias("low"), F.max_by(F.struct("key", "n"), "key").alias("high"))
    listed = edge.select(PART, F.explode(F.array_distinct(F.array("low", "high"))).alias("e")).select(PART, "e.key", "e.n")
    before = F.sum("n").over(Window.partitionBy("key").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    shift = listed.select(F.col(PART).alias("_at"), F.col("key").alias("_edge"), before.alias("_before")).where("_before > 0")
    joined = local.withColumn("_key", _key(keys)).join(F.broadcast(shift), (F.col(PART) == F.col("_at")) & F.col("_key").eqNullSafe(F.col("_edge")), "left")
    return joined.select(*rows.columns, (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("long").alias(number))


def neighbours(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with before_c and after_c for each c of ``columns``: what ``lag`` and ``lead`` by ``keys`` in ``order`` give; ``order`` has no ties."""
    dealt = parts(rows, keys, order)
    value = F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(columns)))
    row = F.struct(_key(keys).alias("key"), value.alias("value"))
    at = F.struct(_key(keys).alias("key"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    # Each part's first and last rows; those of the next part that has rows follow them.
    edge = dealt.groupBy(PART).agg(F.min_by(row, at).alias("low"), F.max_by(row, at).alias("high"))
    along = Window.orderBy(PART)
    edge = edge.select(F.col(PART).alias("_at"), F.lag("high").over(along).alias("_prior"), F.lead("low").over(along).alias("_next"))
    own = Window.partitionBy(PART, *keys).orderBy(*order)
    local = dealt.withColumns({"_value": value, "_key": _key(keys)})
    local = local.withColumns({"_lag": F.lag("_value").over(own), "_lead": F.lead("_value").over(own)})
    joined = local.join(F.broadcast(edge), F.col(PART) == F.col("_at"), "left")

    def filled(found: str, other: str) -> Column:
        return F.when(F.col(found).isNotNull(), F.col(found)).when(F.col(f"{other}.key").eqNullSafe(F.col("_key")), F.col(f"{other}.value"))

    joined = joined.withColumns({"_lag": filled("_lag", "_prior"), "_lead": filled("_lead", "_next")})
    found = [F.col(f"{s}.v{i}").alias(f"{side}_{c}") for side, s in (("before", "_lag"), ("after", "_lead")) for i, c in enumerate(columns)]
    return joined.select(*rows.columns, *found)
