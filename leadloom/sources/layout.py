"""Declared indexes as layout: how a table's files are cut, bucketed, sorted and filtered so that lookups and joins skip data.

Parquet has no index.  What stands for one: folders by a column of few values, buckets by a reference
(joins by it need no shuffle), files sorted within a bucket (row groups outside a range are skipped)
and Bloom filters on the other indexed columns (row groups without a value are skipped).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .registry import Table


@dataclass(frozen=True)
class Layout:
    """``folders``: partition columns; ``bucket``: the column by whose hash rows are dealt over ``buckets``; ``sort``: within a bucket; ``bloom``: filtered columns."""

    folders: tuple[str, ...] = ()
    bucket: str | None = None
    buckets: int = 16
    sort: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()


def layout_of(table: Table, buckets: int = 16) -> Layout:
    """The layout that a table's declared indexes ask for.

    The first index on an enum alone gives the folders, the first on a reference the buckets, or the key does;
    the longest index that starts with the bucket's column gives the order within; all other columns
    that lead an index, and the key, get Bloom filters.
    """
    first = [columns for columns in table.indexes.values()]
    alone = [c for columns in first for c in columns if len(columns) == 1]
    folders = tuple(c for c in alone if table.column(c).enum)[:1]
    bucket = next((c for c in alone if table.column(c).kind == "uuid"), table.key)
    sort = max((c for c in first if c[0] == bucket), key=len, default=(bucket,))
    leading = dict.fromkeys([*(columns[0] for columns in first), table.key])
    bloom = tuple(c for c in leading if c != bucket and c not in folders and table.column(c).kind in ("uuid", "text"))
    return Layout(folders, bucket, buckets, sort, bloom)


def write(df: DataFrame, path: str, layout: Layout) -> DataFrame:
    """Write ``df`` to a new folder in a layout; returns the table, read through its buckets."""
    spark, name = df.sparkSession, f"laid_{uuid.uuid4().hex}"
    # Dealt as the buckets are, so that each task writes one bucket: a file for each folder in it.
    writer = (df.repartition(layout.buckets, layout.bucket) if layout.bucket else df).write.format("parquet")
    for c in layout.bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
    if layout.folders:
        writer = writer.partitionBy(*layout.folders)
    if layout.bucket:
        writer = writer.bucketBy(layout.buckets, layout.bucket).sortBy(*(layout.sort or (layout.bucket,)))
    elif layout.sort:
        raise ValueError("an order needs a bucket")
    writer.option("path", path).saveAsTable(name)
    return spark.table(name)


def read(spark: SparkSession, path: str, schema: str, layout: Layout) -> DataFrame:
    """A folder written by ``write``, in another session: its layout is declared again, its files stay as they are.

    ``schema``: its columns with their types, folder columns last.
    """
    name = f"laid_{uuid.uuid4().hex}"
    folders = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in layout.folders)})" if layout.folders else ""
    order = ", ".join(f"`{c}`" for c in layout.sort or (layout.bucket,))
    bucket = f" CLUSTERED BY (`{layout.bucket}`) SORTED BY ({order}) INTO {layout.buckets} BUCKETS" if layout.bucket else ""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet{folders}{bucket} LOCATION '{path}'")
    if layout.folders:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)
