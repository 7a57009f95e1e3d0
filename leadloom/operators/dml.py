"""Writes as next states: insert-or-ignore, defaults, and what a delete does to other tables.

Parquet enforces no rule and holds no transaction, so each function gives the whole next state, to be
validated and written by a single writer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import canonical_key, json_key
from ..sources.registry import foreign_keys, load_order, tables
from ..sources.warehouse import stored
from .delta import new_rows


def insert_or_ignore(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` and those rows of ``batch`` whose key is new, one for each key; existing rows win.

    Of batch rows with equal keys the first in the order of all columns stays.  A key with a null is new.
    Existing rows pass as they are: only their keys meet the batch.
    """
    return existing.unionByName(new_rows(existing, batch, keys))


def with_defaults(name: str, rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of a table with the columns they omit; a default fills an omitted column only, never a null.

    Random ids derive from the row's content and, among equal rows, its number, so rows have different ids
    and a repeated task gives the same ones.  The generated key of ``metrics`` is computed here too.
    """
    table, out = tables()[name], rows
    now = F.current_timestamp() if now is None else now
    given = rows.columns
    if any(c.default == "random" and c.name not in given for c in table.columns):
        content = F.sha2(F.to_json(F.struct(*given), {"ignoreNullFields": "false"}), 256)
        out = out.withColumn("_content", content)
        out = out.withColumn("_nth", F.row_number().over(Window.partitionBy("_content").orderBy("_content")))
    for c in table.columns:
        if c.name in given:
            continue
        if c.default == "random":
            digest = F.sha2(F.concat_ws("#", "_content", "_nth"), 256)
            parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
            value = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in parts))
        elif c.default == "now":
            value = now
        elif c.kind == "json":
            value = F.parse_json(F.lit(c.default)) if c.default else F.lit(None).cast("variant")
        else:
            value = F.lit(c.default).cast(c.type)
        out = out.withColumn(c.name, value)
    if name == "metrics":
        if "dimension_key" in given:
            raise ValueError("dimension_key is generated")
        out = with_dimension_key(out.drop("dimension_key"))
    return out.select(*(c.name for c in table.columns))


def with_dimension_key(rows: DataFrame, dimension: str = "dimension", key: str = "dimension_key") -> DataFrame:
    """The generated key of a column that holds JSON (variant, or any map, array or struct); a caller's own value is refused.

    The key of any JSON costs far more than a row does otherwise, so it is made once for each different text
    and met by the text; the rows are computed once for both, at the call, and written.
    """
    if key in rows.columns:
        raise ValueError(f"{key} is generated")
    if rows.schema[dimension].dataType.simpleString() == "map<string,string>":
        return rows.withColumn(key, canonical_key(F.col(dimension)))
    told = stored(rows.withColumn("_text", F.to_json(F.col(dimension), {"ignoreNullFields": "false"})), "dimensions")
    keys = told.select(F.col("_text").alias("_of")).where("_of is not null").distinct().withColumn("_key", json_key(F.col("_of")))
    return told.join(keys, F.col("_text") == F.col("_of"), "left").select(*rows.columns, F.col("_key").alias(key))


def delete_cascade(state: dict[str, DataFrame], name: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The next state of all tables in ``state`` after deleting the rows of ``name`` with an id in ``gone`` (id).

    Tables follow in load order: a row goes if a cascading reference does, then references that are set
    null on delete lose what is gone.  The ids lost at a level are written before the next one reads them.
    A restricting reference to a gone row raises ValueError.
    """
    lost = {name: stored(gone.select("id").distinct(), f"lost-{name}")}
    out = dict(state)
    order = [t for level in load_order() for t in level]
    for table in order:
        if table not in state:
            continue
        own = [k for k in foreign_keys() if k.child == table and k.parent in lost]
        found = [lost[table]] if table in lost else []
        for k in (k for k in own if k.action == "cascade" and k.column in state[table].columns):
            found.append(state[table].join(lost[k.parent].withColumnRenamed("id", "_gone"), F.col(k.column) == F.col("_gone"), "left_semi").select("id"))
        if len(found) > (table in lost):
            ids = found[0]
            for more in found[1:]:
                ids = ids.union(more)
            lost[table] = stored(ids.distinct(), f"lost-{table}")
        if table in lost:
            out[table] = out[table].join(lost[table], "id", "left_anti")
        for k in (k for k in own if k.action == "set_null" and k.column in state[table].columns):
            out[table] = set_null(out[table], k.column, lost[k.parent])
        for k in (k for k in own if k.action == "restrict" and k.column in state[table].columns):
            if restrict_blockers(out[table], k.column, lost[k.parent]).limit(1).count():
                raise ValueError(f"{k.name} restricts the delete")
        out[table] = out[table].select(*state[table].columns)
    return out


def set_null(child: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``child`` with null instead of references to ``gone`` (id)."""
    marked = child.join(gone.select(F.col("id").alias("_gone")).distinct(), F.col(column) == F.col("_gone"), "left")
    return marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")


def restrict_blockers(child: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Child rows that forbid a delete of ``gone`` (id)."""
    return child.join(gone.select(F.col("id").alias("_gone")), F.col(column) == F.col("_gone"), "left_semi")


def touched(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """What an update helper does besides: a new ``updated_at``."""
    return rows.withColumn("updated_at", F.current_timestamp() if now is None else now)
