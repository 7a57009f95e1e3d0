"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.warehouse import shared_folder


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, so that JVM and Python hold little text at once beside a task's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def nameless(df: DataFrame, but: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """``df`` without the columns ``but``, the others called c0, c1, ... so that no name is resolved again, and their names."""
    kept = [k for k, c in enumerate(df.columns) if c not in set(but)]
    renamed = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return renamed.select(*(F.col(f"c{k}").alias(f"c{j}") for j, k in enumerate(kept))), [df.columns[k] for k in kept]


def quoted(name: str) -> str:
    """A column's name as an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def named(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` with these names, by place."""
    return df.toDF(*names)


#: Rows that a task of a small table gets at least.
TASK_ROWS = 20_000


_WRITTEN: list[str] = []


def clear(spark: SparkSession) -> None:
    """Remove the tables that ``stored`` has written; results that still read them must be written first."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df`` in no more tasks than its number of ``rows`` asks for, at ``each`` for a task; no shuffle.

    Large tables keep their partitions; small ones do not pay for hundreds of empty tasks.
    """
    return df.coalesce(rows // each + 1)


def stored(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what is written, and the
    table's statistics let Spark choose the next joins by size.  ``rows``: about how many there are, if known.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    if rows is not None:
        df = few(df, rows)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
