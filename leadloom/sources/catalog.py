"""The catalog of stored tables, as tables: read from the schemas of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import warehouse

SCHEMA = "public"


def info_tables(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(SCHEMA, t) for t in warehouse.listed(spark, root)], "table_schema string, table_name string")


def info_namespaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, SCHEMA), (2, "pg_catalog")], "namespace_id int, namespace_name string")


def info_enums(spark: SparkSession, root: str) -> DataFrame:
    """The enums of all columns."""
    found = {f.metadata["enum"]: list(f.metadata["values"]) for schema, _ in warehouse.schemas(spark, root).values() for f in schema if "enum" in f.metadata}
    return spark.createDataFrame([(1, n, "e", v) for n, v in sorted(found.items())], "namespace_id int, type_name string, type_kind string, labels array<string>")


def info_indexes(spark: SparkSession, root: str) -> DataFrame:
    """Declared indexes, and those that keys and unique constraints bring."""
    rows = []
    for name, (_, rules) in warehouse.schemas(spark, root).items():
        own = {f"{name}_pkey": [rules["key"]]} | rules["indexes"] | rules["uniques"] if rules else {}
        rows += [(SCHEMA, name, n, c) for n, c in own.items()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, index_name string, columns array<string>")


def info_constraints(spark: SparkSession, root: str) -> DataFrame:
    """Kinds: p primary key, u unique, c check, f foreign key.  Names are cut at 63 characters, as a server would."""
    rows = []
    for name, (_, rules) in warehouse.schemas(spark, root).items():
        if rules:
            rows += [(1, name, f"{name}_pkey", "p", [rules["key"]])]
            rows += [(1, name, n, "u", c) for n, c in rules["uniques"].items()]
            rows += [(1, name, n, "c", []) for n in rules["checks"]]
            rows += [(1, name, n[:63], "f", [r[0]]) for n, r in rules["references"].items()]
    return spark.createDataFrame(rows, "namespace_id int, table_name string, constraint_name string, kind string, columns array<string>")
