"""The model's tables as Parquet folders below one root; their rules travel in the files' schemas."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .registry import ENUMS, Table, foreign_keys, tables


_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, in local mode only, a temporary one of the application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="leadloom-")
    return _FOLDERS[app]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that what follows does not compute it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def files(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files below a folder, by name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return sorted(r["path"] for r in found.select("path").collect())


def described(table: Table) -> StructType:
    """The table's schema with its rules: enums at their columns, keys, uniques, checks, indexes and references at its key."""
    rules = {
        "key": table.key, "uniques": {n: list(c) for n, c in table.uniques.items()}, "checks": dict(table.checks), "indexes": {n: list(c) for n, c in table.indexes.items()},
        "references": {k.name: [k.column, k.parent, k.action] for k in foreign_keys() if k.child == table.name},
    }
    fields = []
    for c in table.columns:
        enum = {"enum": c.kind, "values": list(ENUMS[c.kind])} if c.enum else {}
        fields.append(StructField(c.name, c.type, True, enum | ({"rules": json.dumps(rules)} if c.name == table.key else {})))
    return StructType(fields)


def create(spark: SparkSession, root: str, names: Iterable[str] | None = None) -> None:
    """Write the tables of these names, all by default, without rows."""
    for name in tables() if names is None else names:
        spark.createDataFrame([], described(tables()[name])).coalesce(1).write.parquet(f"{root}/{name}/created")


def append(rows: DataFrame, root: str, name: str) -> None:
    """Add rows, which a writer has validated, to a table."""
    table = described(tables()[name])
    rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in table)).write.parquet(f"{root}/{name}/{uuid.uuid4().hex}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The rows of a table; None if it does not exist."""
    try:
        return spark.read.option("recursiveFileLookup", True).parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def listed(spark: SparkSession, root: str) -> list[str]:
    """The names of the tables that are there, at most some dozens."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    names = files.select(F.element_at(F.split("path", "/"), -3).alias("name")).distinct()
    return sorted(r["name"] for r in names.collect())


def schemas(spark: SparkSession, root: str) -> dict[str, tuple[StructType, dict]]:
    """By table, its stored schema and its rules."""
    out = {}
    for name in listed(spark, root):
        schema = read(spark, root, name).schema
        rules = [json.loads(f.metadata["rules"]) for f in schema if "rules" in f.metadata]
        out[name] = (schema, rules[0] if rules else {})
    return out
