"""Rows that break a declared rule.  Nulls pass checks, are distinct in unique keys and refer to nothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.registry import Table, foreign_keys, tables


def check_violations(rows: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows for which the predicate is false; a null result passes."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return rows.where(~F.coalesce(condition, F.lit(True)))


def domain_violations(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return check_violations(rows, F.col(column).isin(*values))


def null_violations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n): how many nulls each required column holds, where it holds any; one pass over the rows."""
    counts = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    listed = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns))
    return counts.select(F.explode(listed).alias("x")).select("x.column", "x.n").where("n > 0")


def unique_violations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns..., n) of keys that stand more than once; a key with a null is unique."""
    whole = rows.dropna(subset=list(columns))
    return whole.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def reference_violations(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose reference is not null and names no parent."""
    keys = parent.select(F.col(key).alias("_key"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


@dataclass(frozen=True)
class Rules:
    """``rows``: by rule, when a row breaks it; ``keys``: unique columns; ``references``: (column, parent rows, parent key)."""

    rows: dict[str, Column] = field(default_factory=dict)
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    references: dict[str, tuple[str, DataFrame, str]] = field(default_factory=dict)


def rules_of(table: Table, parents: dict[str, DataFrame] | None = None) -> Rules:
    """The declared rules of a table; references to the ``parents`` that are given."""
    broken = {f"{table.name}.{c.name} not null": F.col(c.name).isNull() for c in table.columns if c.required}
    broken |= {name: ~F.coalesce(F.expr(predicate), F.lit(True)) for name, predicate in table.checks.items()}
    broken |= {f"{table.name}.{c.name} domain": ~F.coalesce(F.col(c.name).isin(*c.enum), F.lit(True)) for c in table.columns if c.enum}
    own = [k for k in foreign_keys() if k.child == table.name and parents and k.parent in parents]
    return Rules(broken, {f"{table.name}_pkey": (table.key,), **table.uniques}, {k.name: (k.column, parents[k.parent], "id") for k in own})


def named_count(name: str, found: DataFrame) -> DataFrame:
    """(constraint_name, n) of the rows found, if there are any."""
    return found.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("constraint_name"), "n")


def row_violations(rows: DataFrame, rules: Rules) -> DataFrame:
    """(constraint_name, n) of the rules that need one row alone; one pass."""
    counts = rows.agg(F.count("*").alias("all"), *(F.count_if(condition).alias(f"n{k}") for k, condition in enumerate(rules.rows.values())))
    listed = [F.struct(F.lit(name).alias("constraint_name"), F.col(f"n{k}").alias("n")) for k, name in enumerate(rules.rows)]
    none = F.struct(F.lit("").alias("constraint_name"), F.lit(0).cast("long").alias("n"))
    return counts.select(F.explode(F.array(none, *listed)).alias("x")).select("x.constraint_name", "x.n").where("n > 0")


def violations(rows: DataFrame, rules: Rules) -> DataFrame:
    """(constraint_name, n) for every rule that ``rows`` break; each unique key and each reference needs a shuffle of its own."""
    out = row_violations(rows, rules)
    for name, columns in rules.keys.items():
        out = out.union(named_count(name, unique_violations(rows, columns)))
    for name, (column, parent, key) in rules.references.items():
        out = out.union(named_count(name, reference_violations(rows, column, parent, key)))
    return out


def validate(name: str, rows: DataFrame, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(constraint_name, n) for every declared rule of a table that ``rows`` break."""
    return violations(rows, rules_of(tables()[name], parents))
