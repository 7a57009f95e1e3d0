"""Changes by delta: what a batch adds, checked and met by keys alone against what is there.

What is there has passed its rules, so only a batch can break one.  Of the old rows nothing but key
columns is read, and of these only what lies between the batch's least and greatest keys; where the
batch is small, Spark sends it to the old keys, which then are not shuffled either.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType, StringType, VariantType
from pyspark.sql.window import Window

from ..sources.warehouse import remove
from .integrity import Rules, named_count, reference_violations, row_violations

_LIMITED = (DateType, DecimalType, IntegralType, StringType)


def fenced(old: DataFrame, batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The key ``columns`` of ``old`` rows that a batch's keys can meet: between the least and the greatest of each column.

    The limits are literals, so a scan skips the files and row groups that lie outside.  Costs one pass over the batch.
    """
    keys, columns = old.select(*columns), [c for c in columns if isinstance(old.schema[c].dataType, _LIMITED)]
    if not columns:
        return keys
    limits = batch.agg(*(f(c).alias(f"{f.__name__}{k}") for k, c in enumerate(columns) for f in (F.min, F.max))).first()
    for k, c in enumerate(columns):
        low, high = limits[f"min{k}"], limits[f"max{k}"]
        # A batch without a whole key meets nothing.
        keys = keys.where(F.col(c).between(F.lit(low), F.lit(high)) if low is not None else F.lit(False))
    return keys


def met_keys(old: DataFrame, batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The different keys of ``batch`` that are in ``old``; keys with a null meet nothing."""
    wanted = batch.select(*columns).dropna().distinct()
    return fenced(old, batch, columns).join(wanted, list(columns), "left_semi").distinct()


def key_violations(old: DataFrame, batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The keys of ``batch`` that stand more than once in it or are in ``old``, if no key stands twice in ``old``."""
    counted = batch.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n"))
    # A key that is in both counts once: those met come from the old keys, the others from the batch.
    met = fenced(old, batch, columns).join(counted, list(columns), "left_semi").distinct()
    return counted.where("n > 1").select(*columns).union(met).distinct()


def delta_violations(old: DataFrame, batch: DataFrame, rules: Rules) -> DataFrame:
    """(constraint_name, n) for every rule that ``old`` and ``batch`` together break, if ``old`` breaks none.

    Rules of single rows and references look at the batch alone, unique keys also at the old rows' key columns.
    """
    out = row_violations(batch, rules)
    for name, columns in rules.keys.items():
        out = out.union(named_count(name, key_violations(old, batch, columns)))
    for name, (column, parent, key) in rules.references.items():
        out = out.union(named_count(name, reference_violations(batch, column, parent, key)))
    return out


def first_of_each(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the first in the order of all columns; rows without a whole key all stay."""
    partial = F.lit(False)
    for k in keys:
        partial = partial | F.col(k).isNull()
    # Rows without a whole key are groups of their own, so that they are no hot key.
    own = batch.withColumn("_own", F.when(partial, F.monotonically_increasing_id()))
    # JSON values have no order of their own; their text has.
    json = {f.name for f in batch.schema if isinstance(f.dataType, VariantType)}
    by = [(F.to_json(c) if c in json else F.col(c)).asc_nulls_last() for c in batch.columns]
    first = F.row_number().over(Window.partitionBy(*keys, "_own").orderBy(*by))
    return own.withColumn("_n", first).where("_n = 1").drop("_own", "_n")


def new_rows(old: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``batch`` that an insert with "on conflict do nothing" adds to ``old``: one for each key that is not there.

    Running the same batch again adds nothing.
    """
    first = first_of_each(batch.select(*old.columns), keys)
    return first.join(met_keys(old, batch, keys), list(keys), "left_anti").select(*old.columns)


def upsert(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str]) -> int:
    """Add the rows of ``batch`` whose key is not there to a Parquet folder, as files of their own; returns how many.

    No file that is there is written again.  A folder that does not exist yet is made.
    """
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    read = spark.read.schema(batch.schema).option("recursiveFileLookup", True)
    new = new_rows(read.parquet(path), batch, keys) if exists else first_of_each(batch, keys)
    part = f"{path}/{uuid.uuid4().hex}"
    new.write.parquet(part)
    n = read.parquet(part).count()
    if not n:
        remove(spark, part)
    return n
