"""Queries of the operators that keep tables up to date and plan what is sent, with their equal DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ordering import canonical_key
from ..operators import delta, entities, funnel, lifecycle, ranges, rollup, sending
from ..operators.integrity import Rules
from ..sources import layout, seed, warehouse
from .catalogue import ORACLES, QUERIES, query, setting_rows, table

__all__ = ["ORACLES", "QUERIES"]

# Changes by delta


_LINES = "SELECT l_orderkey, l_linenumber, l_suppkey, l_discount FROM lineitem"
_BOTH = (
    f"WITH good AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0), old AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM ({_LINES}) SEMI JOIN good ON l_suppkey = s_suppkey"
    f" WHERE l_orderkey % 3 <> 0 AND l_discount > 0 ORDER BY ALL), both_ AS (SELECT * FROM old UNION ALL {_LINES} WHERE l_orderkey % 3 = 0 OR l_orderkey % 30 = 1)"
)


@query(
    f"{_BOTH} SELECT 'positive discount' AS constraint_name, count(*) AS n FROM both_ WHERE NOT l_discount > 0 HAVING n > 0"
    " UNION ALL SELECT 'line', count(*) FROM (SELECT 1 FROM both_ GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) > 0"
    " UNION ALL SELECT 'supplier', count(*) FROM both_ ANTI JOIN good ON l_suppkey = s_suppkey HAVING count(*) > 0"
)
def delta_validation(spark, sf_dir):
    """Lines in two batches: the second is checked by itself and by keys, with the result of checking all."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount")
    good = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    rules = Rules({"positive discount": ~F.coalesce(F.expr("l_discount > 0"), F.lit(True))}, {"line": ("l_orderkey", "l_linenumber")}, {"supplier": ("l_suppkey", good, "s_suppkey")})
    valid = lines.where("l_orderkey % 3 <> 0 AND l_discount > 0").join(good, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    old = warehouse.stored(delta.first_of_each(valid, rules.keys["line"]), "delta-old")
    batch = warehouse.stored(lines.where("l_orderkey % 3 = 0 OR l_orderkey % 30 = 1"), "delta-batch")
    return delta.delta_violations(old, batch, rules)


_ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@query(
    f"WITH old AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) {_ROW} FROM lineitem WHERE l_orderkey % 4 = 0 ORDER BY {_ROW}),"
    f" new AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) {_ROW} FROM lineitem ORDER BY {_ROW})"
    " SELECT *, 1 AS run FROM old UNION ALL SELECT *, 2 FROM new ANTI JOIN old USING (l_orderkey, l_linenumber)"
)
def upsert_delta(spark, sf_dir):
    """A quarter of the lines, then all, then all again: the second run adds the others, the third nothing."""
    lines = table(spark, sf_dir, "lineitem").select(*_ROW.split(", "))
    path = f"{warehouse.shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    for run, rows in enumerate((lines.where("l_orderkey % 4 = 0"), lines, lines), 1):
        delta.upsert(spark, path, rows.withColumn("run", F.lit(run)), ("l_orderkey", "l_linenumber"))
    return spark.read.option("recursiveFileLookup", True).parquet(path)


# Queues, calendars and histories


_KIND = "CASE WHEN event_type = 'click' THEN 'followup' WHEN event_type = 'error' THEN 'other' ELSE 'outreach' END"
_LAST = "2024-03-15"


@query(
    f"""
WITH RECURSIVE e AS (SELECT event_id, CAST(ts AS DATE) AS day, ts, {_KIND} AS kind FROM events),
a AS (SELECT kind, day, count(*) AS n FROM e WHERE kind <> 'other' GROUP BY ALL),
q AS (SELECT kind, min(day) AS day, CAST(0 AS BIGINT) AS before, CAST(least(first(n ORDER BY day), CASE kind WHEN 'outreach' THEN 20 ELSE 25 END) AS BIGINT) AS done, CAST(first(n ORDER BY day) AS BIGINT) AS came FROM a GROUP BY kind
  UNION ALL SELECT q.kind, CAST(q.day + 1 AS DATE), q.done, CAST(least(q.came + coalesce(a.n, 0), q.done + CASE q.kind WHEN 'outreach' THEN 20 ELSE 25 END) AS BIGINT), CAST(q.came + coalesce(a.n, 0) AS BIGINT)
  FROM q LEFT JOIN a ON a.kind = q.kind AND a.day = q.day + 1 WHERE q.day < DATE '{_LAST}'),
m AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY day, ts, event_id) AS k FROM e)
SELECT m.event_id, m.kind, CAST(q.day AS VARCHAR) AS send_day FROM m LEFT JOIN q ON q.kind = m.kind AND k > q.before AND k <= q.done
"""
)
def carry_over_queue(spark, sf_dir):
    """Every message gets the day on which the limits of the settings let it go, or stays queued."""
    limits = seed.setting(setting_rows(spark), "outreach.email.daily_limit")
    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), "ts", F.expr(_KIND).alias("kind"))
    sent = sending.carry_over(rows, {k: limits[k] for k in ("outreach", "followup")}, ["ts", "event_id"], _LAST)
    return sent.select("event_id", "kind", F.col("send_day").cast("string").alias("send_day"))


_ZONE = "CASE user_id % 4 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Asia/Kolkata' ELSE 'America/Chicago' END"


@query(
    f"""
WITH e AS (SELECT event_id, s AS step, ts + to_days(CAST(d AS INTEGER)) AS due, {_ZONE} AS zone FROM events, (VALUES (1, 3), (2, 10)) v(s, d)),
l AS (SELECT *, timezone(zone, due AT TIME ZONE 'UTC') AS local FROM e),
c AS (SELECT *, unnest(range(0, 8)) AS k FROM l),
o AS (SELECT *, CAST(local AS DATE) + CAST(k AS INTEGER) AS day FROM c),
p AS (SELECT event_id, step, due, timezone('UTC', timezone(zone, day + INTERVAL 9 HOUR)) AS opens, timezone('UTC', timezone(zone, day + INTERVAL 17 HOUR)) AS closes FROM o WHERE isodow(day) <= 5)
SELECT event_id, CAST(step AS INTEGER) AS sequence_step, strftime(min(greatest(due, opens)), '%Y-%m-%d %H:%M:%S.%f') AS open_at FROM p WHERE due < closes GROUP BY event_id, step
"""
)
def followups_in_open_hours(spark, sf_dir):
    """Follow-ups of every event after the days of the settings, moved to the next open instant of the contact's zone."""
    settings = setting_rows(spark)
    hours, offsets = (seed.setting(settings, k) for k in ("business.hours", "outreach.followup.day_offsets"))
    due = lifecycle.followup_schedule(table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "ts", offsets)
    found = sending.next_open(due.drop("ts"), "scheduled_at", hours, F.expr(_ZONE))
    return found.select("event_id", "sequence_step", F.date_format("open_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("open_at"))


@query(
    "WITH e AS (SELECT event_id, ts, event_type, CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END AS k FROM events)"
    " SELECT event_id, k, row_number() OVER w AS nth, lag(event_type) OVER w AS before_event_type, CAST(epoch_us(lead(ts) OVER w) - epoch_us(ts) AS BIGINT) AS micros FROM e WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)"
)
def histories_of_hot_keys(spark, sf_dir):
    """Order, state before and time until the next of each event's history; half of all rows are one key's."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.expr("CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END").alias("k"))
    placed = ranges.numbered(rows, ["k"], ["ts", "event_id"], "nth")
    seen = ranges.neighbours(placed, ["k"], ["ts", "event_id"], ["event_type", "ts"])
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("after_ts", "ts")]
    return seen.select("event_id", "k", "nth", "before_event_type", (micros[0] - micros[1]).alias("micros"))


# Funnel, metrics, entities


def _cents(price: str) -> str:
    return f"CAST(round(CAST({price} AS DECIMAL(14,4)) * 100, 0) AS BIGINT)"


@query(
    f"""
WITH RECURSIVE s AS (SELECT o_custkey AS key, 1 AS step, CAST(o_orderdate AS DATE) AS day, 0 AS cents FROM orders
  UNION ALL SELECT o_custkey, 2, CAST(o_orderdate AS DATE), 0 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 0
  UNION ALL SELECT o_custkey, 3, CAST(l_shipdate AS DATE), 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O'
  UNION ALL SELECT o_custkey, 4, CAST(l_shipdate AS DATE), {_cents("l_extendedprice")} FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'),
j AS (SELECT key, 1 AS step, min(day) AS day, CAST(NULL AS DATE) AS before FROM s WHERE step = 1 GROUP BY key
  UNION ALL SELECT key, step, day, before FROM (SELECT j.key, s.step, s.day, j.day AS before, row_number() OVER (PARTITION BY j.key ORDER BY s.day) AS n FROM j JOIN s ON s.key = j.key AND s.step = j.step + 1 AND s.day >= j.day) WHERE n = 1),
p AS (SELECT sum(cents) AS cents FROM s JOIN j ON j.key = s.key AND j.step = 4 AND s.step = 4 AND s.day >= j.day),
r AS (SELECT t.step, stage, count(j.key) AS entities, coalesce(sum(j.day - j.before), 0) AS days_between FROM (VALUES (1, 'opportunity'), (2, 'customer'), (3, 'subscription'), (4, 'payment')) t(step, stage) LEFT JOIN j ON j.step = t.step GROUP BY ALL)
SELECT CAST(step AS INTEGER) AS step, stage, entities, CAST(1000 * entities // lag(entities) OVER (ORDER BY step) AS BIGINT) AS per_mille, CAST(days_between AS BIGINT) AS days_between,
  CAST(CASE WHEN step = 4 THEN coalesce((SELECT cents FROM p), 0) ELSE 0 END AS BIGINT) AS cents FROM r
"""
)
def linked_funnel(spark, sf_dir):
    """Orders are opportunities, won orders of solvent customers make customers, open lines subscriptions and lines that stay payments."""
    o, c, li = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    none = F.lit(0).alias("cents")
    rows = 2 * (o.count() + li.count())  # each table takes two steps
    parts = funnel.tasks(rows)
    orders = o.select("o_orderkey", F.col("o_custkey").alias("key")).repartition(parts, "o_orderkey")
    keyed = li.repartition(parts, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    solvent = c.where("c_acctbal > 0").select("c_custkey")
    won = o.where("o_orderstatus = 'F'").join(solvent, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    cents = F.round(F.col("l_extendedprice").cast("decimal(14,4)") * 100, 0).cast("long").alias("cents")
    steps = [
        o.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), none),
        won.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), none),
        keyed.where("l_linestatus = 'O'").select("key", F.col("l_shipdate").alias("at"), none),
        keyed.where("l_returnflag <> 'R'").select("key", F.col("l_shipdate").alias("at"), cents),
    ]
    return funnel.linked_funnel(steps, ("opportunity", "customer", "subscription", "payment"), rows)


@query(
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS metric_date, event_type AS metric_name, '{\"k\": \"' || json_extract_string(props, '$.k') || '\"}' AS dimension_key,"
    " CAST(sum(CAST(value AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS value, count(*) AS n FROM events GROUP BY ALL"
)
def metrics_in_batches(spark, sf_dir):
    """Three batches, each of rows of all days, the second run twice: the table equals one roll-up of all rows."""
    key = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.to_date("ts").alias("metric_date"), F.col("event_type").alias("metric_name"), canonical_key(key).alias("dimension_key"), "value"
    )
    path = f"{warehouse.shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    for batch, kept in ((1, "event_id % 3 = 0"), (2, "event_id % 3 = 1"), (2, "event_id % 3 = 1"), (3, "event_id % 3 = 2")):
        rollup.merge(spark, path, rows.where(kept).drop("event_id"), batch)
    return rollup.read(spark, path).select(F.col("metric_date").cast("string").alias("metric_date"), "metric_name", "dimension_key", "value", "n")


_TYPE = "CASE WHEN l_linenumber % 4 = 0 THEN 'supplier' WHEN l_linenumber % 4 = 1 THEN 'part' WHEN l_linenumber % 4 = 2 THEN 'order' ELSE 'website' END"
_ENTITY = "CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_linenumber % 4 = 0 THEN l_suppkey WHEN l_linenumber % 4 = 1 THEN l_partkey * 2 WHEN l_linenumber % 4 = 2 THEN l_orderkey END"


@query(
    f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_TYPE} AS entity_type, {_ENTITY} AS entity_id FROM lineitem),
e AS (SELECT 'supplier' AS entity_type, s_suppkey AS entity_id, s_name AS name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'order', o_orderkey, o_orderpriority FROM orders)
SELECT l_orderkey, l_linenumber, r.entity_type, r.entity_id, e.entity_id IS NOT NULL AS found, name FROM r LEFT JOIN e ON e.entity_type = r.entity_type AND e.entity_id = r.entity_id
"""
)
def polymorphic_entities(spark, sf_dir):
    """Lines that point to suppliers, parts, orders and a type that is not there; a third of them to one entity of their type."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_TYPE).alias("entity_type"), F.expr(_ENTITY).alias("entity_id"))
    parents = {
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "part": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        "order": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name")),
    }
    return entities.dispatched(rows, parents)


# Layout


@query(
    "SELECT l_returnflag, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(l_quantity AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS quantity"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"
)
def join_of_laid_out_tables(spark, sf_dir):
    """Lines and orders bucketed by the order: their join moves no row."""
    root = f"{warehouse.shared_folder(spark)}/layout-{uuid.uuid4().hex}"
    lines = layout.write(table(spark, sf_dir, "lineitem"), f"{root}/lines", LINES_LAYOUT)
    orders = layout.write(table(spark, sf_dir, "orders"), f"{root}/orders", layout.Layout(bucket="o_orderkey", bloom=("o_custkey",)))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    quantity = F.sum(F.col("l_quantity").cast("decimal(14,2)")).cast("decimal(24,2)").alias("quantity")
    return joined.groupBy("l_returnflag", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), quantity)


LINES_LAYOUT = layout.Layout(folders=("l_returnflag",), bucket="l_orderkey", sort=("l_orderkey", "l_linenumber"), bloom=("l_partkey",))
