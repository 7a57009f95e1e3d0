"""Rows that point to entities of several types, met with all of them in one join."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entity with more rows than the larger of these is hot: a number, and one in so many of all rows.
HOT_ROWS, HOT_SHARE = 100_000, 4096


def dispatched(rows: DataFrame, parents: Mapping[str, DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` (entity_type, entity_id, ...) with found, and the columns of the entity that they point to; all rows stay.

    ``parents``: by type, rows with an ``id``, different within a type, and columns named alike and of one
    kind in all types.  A row with an unknown type, no id, or an id that no parent has is dangling: found is false.
    All types meet in one shuffle by (type, id).  The rows of a hot entity are dealt over as many keys as
    its number asks for, and the entity stands at each of them; of such entities there are at most
    ``HOT_SHARE``, so their list is sent to all tasks.
    """
    known = None
    for kind, parent in parents.items():
        own = parent.withColumnRenamed("id", "_id").withColumns({"_id": F.col("_id").cast("long"), "_type": F.lit(kind)})
        known = own if known is None else known.unionByName(own)
    whole = F.col("entity_type").isin(*parents) & F.col("entity_id").isNotNull()
    # A row that can find nothing keeps out of the shuffle, in which all of them would be one key.
    given, lost = rows.where(F.coalesce(whole, F.lit(False))), rows.where(~F.coalesce(whole, F.lit(False)))
    counts = given.groupBy("entity_type", F.col("entity_id").cast("long").alias("entity_id")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    limit = max(hot_rows, -(-total // HOT_SHARE))
    hot = counts.where(F.col("_n") > limit).select(F.col("entity_type").alias("_hot_type"), F.col("entity_id").alias("_hot_id"), F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))
    salted = given.join(F.broadcast(hot), (F.col("entity_type") == F.col("_hot_type")) & (F.col("entity_id") == F.col("_hot_id")), "left")
    salted = salted.withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0)).cast("int")).drop("_hot_type", "_hot_id", "_salts")
    spread = known.join(F.broadcast(hot), (F.col("_type") == F.col("_hot_type")) & (F.col("_id") == F.col("_hot_id")), "left")
    spread = spread.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_hot_type", "_hot_id", "_salts")
    met = (F.col("entity_type") == F.col("_type")) & (F.col("entity_id") == F.col("_id")) & (F.col("_salt") == F.col("_part"))
    columns = [c for c in known.columns if c not in ("_id", "_type")]
    joined = salted.join(spread, met, "left").select(*rows.columns, F.col("_id").isNotNull().alias("found"), *columns)
    kinds = dict(known.dtypes)
    return joined.unionByName(lost.select("*", F.lit(False).alias("found"), *(F.lit(None).cast(kinds[c]).alias(c) for c in columns)))
