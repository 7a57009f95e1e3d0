"""The writer: next state of a table from a change, validated before it is written.

Parquet holds no transaction, so there is one writer at a time; what it writes is a whole new state, or
for ``append`` rows that leave the others as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import warehouse
from ..sources.registry import tables
from .delta import delta_violations, new_rows
from .dml import insert_or_ignore, touched, with_defaults, with_dimension_key
from .integrity import rules_of, validate

#: Tables that take new rows only.
LOGS = ("audit_logs",)


class Refused(ValueError):
    """The rules that a change would break, with the numbers of rows."""

    def __init__(self, name: str, broken: dict[str, int]):
        super().__init__(f"{name}: " + ", ".join(f"{k} ({n})" for k, n in sorted(broken.items())))
        self.broken = broken


def inserted(name: str, existing: DataFrame, rows: DataFrame, on_conflict: Sequence[str] | None = None, now: Column | None = None) -> DataFrame:
    """``existing`` and ``rows`` with defaults and the generated key; with ``on_conflict`` rows whose key is there are left out.

    What a conflict looks for passes over the new rows several times, so they are computed once, at the call, and written.
    """
    new = with_defaults(name, rows, now)
    same = existing.select(*new.columns)
    return insert_or_ignore(same, warehouse.stored(new, f"insert-{name}"), on_conflict) if on_conflict else same.unionByName(new)


def updated(name: str, existing: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """``existing`` with the columns of ``changes`` (key, changed columns) in the rows of their keys.

    A changed row gets a new ``updated_at`` if the table has one, and its generated key anew.  Logs, generated
    columns, unknown columns and keys that stand twice in ``changes`` are refused; unknown keys change nothing.
    """
    table = tables()[name]
    columns = [c for c in changes.columns if c != table.key]
    known = {c.name for c in table.columns}
    if name in LOGS:
        raise ValueError(f"{name} is append-only")
    if "dimension_key" in columns:
        raise ValueError("dimension_key is generated")
    if not set(columns) <= known:
        raise ValueError(f"{name} has no columns {sorted(set(columns) - known)}")
    twice = changes.groupBy(table.key).agg(F.count("*").alias("n")).where("n > 1")
    if twice.limit(1).count():
        raise ValueError(f"a {table.key} of {name} is changed twice")
    new = changes.select(F.col(table.key).alias("_key"), F.struct(*columns).alias("_new"))
    joined = existing.join(new, F.col(table.key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    for c in columns:
        joined = joined.withColumn(c, F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)))
    if "updated_at" in known:
        fresh = touched(joined.select("*", F.col("updated_at").alias("_before")), now)
        joined = fresh.withColumn("updated_at", F.when(hit, F.col("updated_at")).otherwise(F.col("_before")))
    if name == "metrics" and "dimension" in columns:
        joined = with_dimension_key(joined.drop("dimension_key"))
    return joined.select(*existing.columns)


def write(name: str, state: DataFrame, path: str, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Write a next state to a new folder, and read it back; if it breaks a rule the folder goes and ``Refused`` is raised.

    The state is computed once, for the write; its rules are checked on what was written.
    """
    state.write.parquet(path)
    made = state.sparkSession.read.schema(state.schema).parquet(path)
    broken = {r["constraint_name"]: r["n"] for r in validate(name, made, parents).collect()}
    if broken:
        warehouse.remove(state.sparkSession, path)
        raise Refused(name, broken)
    return made


def append(name: str, rows: DataFrame, root: str, parents: dict[str, DataFrame] | None = None, now: Column | None = None) -> int:
    """Add rows to a stored table if it keeps its rules; returns their number.

    The rows are checked alone, and their keys against the keys that are there; nothing that is there is
    read otherwise or changes.
    """
    new = warehouse.stored(with_defaults(name, rows, now), f"append-{name}")
    there = _there(rows.sparkSession, root, name)
    broken = {r["constraint_name"]: r["n"] for r in delta_violations(there, new, rules_of(tables()[name], parents)).collect()}
    if broken:
        raise Refused(name, broken)
    n = new.count()
    if n:
        warehouse.append(new, root, name)
    return n


def _there(spark: SparkSession, root: str, name: str) -> DataFrame:
    there = warehouse.read(spark, root, name)
    if there is None:
        raise ValueError(f"there is no table {name}")
    return there


def upsert(name: str, rows: DataFrame, root: str, on_conflict: Sequence[str], parents: dict[str, DataFrame] | None = None, now: Column | None = None) -> int:
    """``append`` the rows whose key is not in a stored table, one for each key; returns how many: none the second time."""
    there = _there(rows.sparkSession, root, name)
    given = with_defaults(name, rows, now)
    return append(name, new_rows(there.select(*given.columns), warehouse.stored(given, f"upsert-{name}"), on_conflict).drop(*_generated(name)), root, parents, now)


def _generated(name: str) -> tuple[str, ...]:
    return ("dimension_key",) if name == "metrics" else ()
