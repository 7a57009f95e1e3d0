"""The queries of the relational operators over the driver's tables, and their equal DuckDB SQL.

Each query is one operator of the library on the table that stands for the modelled one: customers for
businesses, orders and events for histories and queues, lineitem for details.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import by_enum, enum_rank
from ..functions.scoring import classes_of, lead_class, lead_priority, weight_sum, weighted_score
from ..operators import dml, integrity, lifecycle, metrics, verification, writer
from ..sources import catalog, seed, warehouse
from ..sources.registry import ENUMS
from . import expected

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# An order of market segments that is not the alphabet's.
SEGMENTS = ("MACHINERY", "AUTOMOBILE", "BUILDING", "HOUSEHOLD", "FURNITURE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function as a query under its own name or ``name``, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple]) -> str:
    """Rows as the list of an SQL VALUES."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_MODELS: dict[tuple[str, ...], str] = {}


def model(spark: SparkSession, *names: str) -> str:
    """The root of the model's own tables, written once for an application: those of these names, all by default, and the seed rows through the writer."""
    key = (spark.sparkContext.applicationId, *names)
    if key not in _MODELS:
        root = f"{warehouse.shared_folder(spark)}/model-{uuid.uuid4().hex}"
        warehouse.create(spark, root, names or None)
        if "system_settings" in names or not names:
            writer.append("system_settings", seed.settings(spark), root)
        if "scoring_versions" in names or not names:
            versions = seed.scoring_versions(spark).withColumn("weights", F.parse_json(F.to_json("weights")))
            writer.append("scoring_versions", versions, root)
        _MODELS[key] = root
    return _MODELS[key]


def setting_rows(spark: SparkSession) -> DataFrame:
    """The stored settings."""
    return warehouse.read(spark, model(spark, "system_settings"), "system_settings")


# Scans, projections, filters, sorts


@query("SELECT n_nationkey, n_name FROM nation")
def scan_project(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name")


@query("SELECT CAST(count(*) AS INTEGER) AS n FROM orders")
def count_all_int(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").cast("int").alias("n"))


@query("SELECT o_orderpriority, CAST(count(*) AS INTEGER) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def filtered_group_count(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return orders.groupBy("o_orderpriority").agg(F.count("*").cast("int").alias("n"))


@query("SELECT c_mktsegment, CAST(count(*) AS INTEGER) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def boolean_filter_count(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("is_active", F.col("c_acctbal") > 0).where("is_active")
    return rows.groupBy("c_mktsegment").agg(F.count("*").cast("int").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT LIKE '1-%'")
def not_like_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where((F.col("o_orderstatus") == "O") & ~F.col("o_orderpriority").like("1-%")).select("o_orderkey", "o_orderstatus")


@query(f"SELECT t AS table_name FROM (VALUES {_values([(t,) for t in expected.TABLES])}) v(t) WHERE t NOT LIKE 'website%'")
def catalog_tables(spark, sf_dir):
    rows = catalog.info_tables(spark, model(spark))
    return rows.where((F.col("table_schema") == catalog.SCHEMA) & ~F.col("table_name").like("website%")).select("table_name")


_INDEX_ROWS = [(t, n) for t, _, names in (line.partition(": ") for line in expected.INDEXES.strip().splitlines()) for n in names.split()]


@query(f"SELECT t AS table_name, n AS index_name FROM (VALUES {_values(_INDEX_ROWS)}) v(t, n)")
def catalog_indexes(spark, sf_dir):
    return catalog.info_indexes(spark, model(spark)).where(F.col("table_schema") == catalog.SCHEMA).select("table_name", "index_name")


_ENUM_ROWS = [(n, int(k)) for n, _, k in (x.partition("=") for x in expected.ENUMS)]


@query(f"SELECT e AS type_name, CAST(k AS INTEGER) AS n_values FROM (VALUES {_values(_ENUM_ROWS)}) v(e, k)")
def catalog_enums_join(spark, sf_dir):
    t, n = catalog.info_enums(spark, model(spark)).alias("t"), catalog.info_namespaces(spark).alias("n")
    joined = t.join(n, F.col("t.namespace_id") == F.col("n.namespace_id")).where((F.col("n.namespace_name") == catalog.SCHEMA) & (F.col("t.type_kind") == "e"))
    return joined.select("t.type_name", F.size("t.labels").alias("n_values"))


@query(f"SELECT n AS constraint_name, k AS kind FROM (VALUES {_values([(n, k) for k, names in expected.CONSTRAINTS.items() for n in names])}) v(n, k)")
def catalog_constraints_join(spark, sf_dir):
    c, n = catalog.info_constraints(spark, model(spark)).alias("c"), catalog.info_namespaces(spark).alias("n")
    joined = c.join(n, F.col("c.namespace_id") == F.col("n.namespace_id")).where(F.col("n.namespace_name") == catalog.SCHEMA)
    return joined.select("c.constraint_name", "c.kind")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_nationkey > 5")
def namespace_join(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation").alias("n"), table(spark, sf_dir, "region").alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).where((F.col("r.r_name") == "ASIA") & (F.col("n.n_nationkey") > 5)).select("n.n_name", "r.r_name")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_name NULLS LAST, c_custkey")
def sort_single(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.asc_nulls_last("c_name"), "c_custkey")


@query(f"SELECT k AS key, t AS type, x AS text FROM (VALUES {_values(expected.SETTINGS)}) v(k, t, x) ORDER BY k")
def settings_dump(spark, sf_dir):
    return verification.settings_dump(setting_rows(spark))


@query(
    f"SELECT c_mktsegment, c_nationkey, CAST(list_position({list(SEGMENTS)!r}, c_mktsegment) AS BIGINT) AS segment_rank, count(*) AS n"
    " FROM customer GROUP BY c_mktsegment, c_nationkey ORDER BY segment_rank, c_nationkey"
)
def sort_enum_then_int(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    ranked = rows.withColumn("segment_rank", enum_rank(F.col("c_mktsegment"), SEGMENTS).cast("long"))
    return ranked.orderBy(by_enum(F.col("c_mktsegment"), SEGMENTS), F.asc_nulls_last("c_nationkey"))


# Joins


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS ok FROM customer")
def membership_exists(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").select("c_custkey")
    actual = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return verification.membership(expected, actual, "c_custkey")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'P') USING (c_custkey)")
def membership_missing(spark, sf_dir):
    found = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    return table(spark, sf_dir, "customer").join(found, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, o_custkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fk_join_inner(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "l_extendedprice")


@query(
    "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"
)
def fk_join_left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query(
    "SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey"
    " JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY ALL"
)
def fk_join_dual_alias(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = joined.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    c, s = nation.alias("c"), nation.alias("s")
    named = counts.join(c, F.col("c_nationkey") == F.col("c.n_nationkey")).join(s, F.col("s_nationkey") == F.col("s.n_nationkey"))
    return named.groupBy(F.col("c.n_name").alias("customer_nation"), F.col("s.n_name").alias("supplier_nation")).agg(F.sum("n").alias("n"))


@query(
    "SELECT r_name, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
)
def fk_join_chain(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(14,2)")).alias("q"))
    joined = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.sum("n").alias("n"), F.sum("q").cast("decimal(24,2)").alias("quantity"))


_ENTITIES = "(SELECT 'customer' AS entity_type, c_custkey AS entity_id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)"


@query(
    f"SELECT l_orderkey, l_linenumber, entity_type, name FROM (SELECT l_orderkey, l_linenumber, 'supplier' AS entity_type, l_suppkey AS entity_id FROM lineitem)"
    f" JOIN {_ENTITIES} USING (entity_type, entity_id)"
)
def polymorphic_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("entity_type"), F.col("c_custkey").cast("long").alias("entity_id"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("entity_type"), F.col("s_suppkey").cast("long").alias("entity_id"), F.col("s_name").alias("name"))
    logs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("supplier").alias("entity_type"), F.col("l_suppkey").alias("entity_id"))
    return logs.join(c.union(s), ["entity_type", "entity_id"]).select("l_orderkey", "l_linenumber", "entity_type", "name")


# Writes and integrity


@query(
    "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL"
    " SELECT c_custkey, 'new ' || c_name, c_nationkey FROM customer WHERE c_custkey % 3 <> 0"
)
def upsert_do_nothing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    batch = c.withColumn("c_name", F.concat(F.lit("new "), "c_name"))
    return dml.insert_or_ignore(c.where("c_custkey % 3 = 0"), batch.union(batch), ["c_custkey"])


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query(
    f"WITH old AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) {', '.join(_LINE)} FROM lineitem WHERE l_orderkey % 4 = 0 ORDER BY {', '.join(_LINE)}),"
    f" new AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) {', '.join(_LINE)} FROM lineitem ORDER BY {', '.join(_LINE)})"
    " SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (l_orderkey, l_linenumber)"
)
def upsert_do_nothing_composite(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*_LINE)
    none = lines.where("false")
    old = dml.insert_or_ignore(none, lines.where("l_orderkey % 4 = 0"), _LINE[:2])
    return dml.insert_or_ignore(old, lines, _LINE[:2])


@query("SELECT c_custkey, bal FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer) WHERE NOT coalesce(bal BETWEEN 0 AND 5000 OR bal IS NULL, true)")
def check_violations_range(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"))
    return integrity.check_violations(rows, F.col("bal").between(0, 5000) | F.col("bal").isNull())


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE NOT l_discount > 0")
def check_violations_positive(spark, sf_dir):
    return integrity.check_violations(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount > 0")


@query("SELECT event_id, event_type FROM events WHERE NOT event_type IN ('click', 'view', 'signup')")
def check_violations_in(spark, sf_dir):
    return integrity.check_violations(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type IN ('click', 'view', 'signup')")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'AUTOMOBILE', 'BUILDING')")
def enum_domain_violations(spark, sf_dir):
    return integrity.domain_violations(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS[:3])


@query("SELECT 'c_nationkey' AS \"column\", count(*) AS n FROM customer WHERE c_nationkey = 3 HAVING count(*) > 0")
def not_null_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")))
    return integrity.null_violations(rows, ["c_custkey", "c_name", "c_nationkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber <> 1 GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")).alias("l_linenumber"))
    return integrity.unique_violations(rows, ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, k FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS k FROM orders) WHERE k IS NOT NULL AND k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)")
def fk_violations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("k"))
    return integrity.reference_violations(orders, "k", table(spark, sf_dir, "customer").where("c_acctbal > 1000"), "c_custkey")


def _business_state(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as businesses, their orders as messages, the orders' lines as follow-ups."""
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    return {
        "businesses": c.select(F.col("c_custkey").alias("id"), "c_nationkey"),
        "customers": c.select((-F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("business_id")),
        "outreach_messages": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("business_id")),
        "followups": li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("outreach_message_id")),
    }


@query(
    "SELECT 'businesses' AS kept, count(*) AS n FROM customer WHERE c_nationkey <> 7 UNION ALL"
    " SELECT 'outreach_messages', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 7 UNION ALL"
    " SELECT 'followups', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 7"
)
def cascade_delete(spark, sf_dir):
    state = _business_state(spark, sf_dir)
    after = dml.delete_cascade(state, "businesses", state["businesses"].where("c_nationkey = 7").select("id"))
    kept = [after[t].agg(F.lit(t).alias("kept"), F.count("*").alias("n")) for t in ("businesses", "outreach_messages", "followups")]
    return kept[0].union(kept[1]).union(kept[2])


@query("SELECT -c_custkey AS id, CASE WHEN c_nationkey <> 7 THEN c_custkey END AS business_id FROM customer")
def set_null_on_delete(spark, sf_dir):
    state = _business_state(spark, sf_dir)
    return dml.delete_cascade(state, "businesses", state["businesses"].where("c_nationkey = 7").select("id"))["customers"]


@query("SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
def restrict_blockers(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("id"))
    return dml.restrict_blockers(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone)


@query("SELECT c_name AS name, 'a@b' AS email, 'ACTIVE' AS status, NULL::VARCHAR AS billing_email FROM customer")
def defaults_applied(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit("a@b").alias("email"))
    return dml.with_defaults("customers", rows).select("name", "email", "status", "billing_email")


# JSON


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_literal(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v"))
    return parsed.select("event_id", F.variant_get("v", "$.k", "int").alias("k"))


@query("SELECT event_id, '{\"k\": \"' || json_extract_string(props, '$.k') || '\", \"type\": \"' || event_type || '\"}' AS dimension_key FROM events")
def json_canonical_key(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), k).alias("dimension"))
    return dml.with_dimension_key(rows).select("event_id", "dimension_key")


# Scores


_QUALITY = "((c_custkey * 7) % 101)"
_CHANCE = "((c_custkey * 13 + 5) % 101)"
_FIT = "((c_custkey * 29 + 3) % 101)"
_PRIORITY = f"CAST((100 - {_QUALITY}) * 0.45 + {_CHANCE} * 0.40 + {_FIT} * 0.15 AS DECIMAL(5,2))"


def _scores(spark, sf_dir):
    weights = seed.setting(setting_rows(spark), "scoring.lead_priority.formula")
    return table(spark, sf_dir, "customer").select("c_custkey", lead_priority(F.expr(_QUALITY), F.expr(_CHANCE), F.expr(_FIT), weights).alias("priority"))


@query(f"SELECT c_custkey, {_PRIORITY} AS priority FROM customer")
def lead_priority_score(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(
    f"SELECT class, count(*) AS n FROM (SELECT CASE WHEN p >= 80 THEN 'HIGH_PRIORITY' WHEN p >= 65 THEN 'SECONDARY' WHEN p >= 50 THEN 'REVIEW' ELSE 'REJECT' END AS class"
    f" FROM (SELECT {_PRIORITY} AS p FROM customer)) GROUP BY class"
)
def lead_classification(spark, sf_dir):
    classes = classes_of(seed.setting(setting_rows(spark), "scoring.lead_classification.thresholds"))
    return _scores(spark, sf_dir).groupBy(lead_class(F.col("priority"), classes).alias("class")).agg(F.count("*").alias("n"))


def _terms(weights: dict) -> str:
    return " + ".join(f"((c_custkey * {k + 3}) % 101) * {w}" for k, w in enumerate(weights.values()))


@query(
    f"SELECT c_custkey, CAST(({_terms(seed.WEBSITE_QUALITY)}) / 100.0 AS DECIMAL(5,2)) AS quality, CAST(({_terms(seed.BUSINESS_OPPORTUNITY)}) / 100.0 AS DECIMAL(5,2)) AS opportunity FROM customer",
    name="weighted_score",
)
def weighted_scores(spark, sf_dir):
    settings = setting_rows(spark)

    def score(kind, categories):
        weights = seed.setting(settings, f"scoring.{kind}.weights")
        return weighted_score({n: F.expr(f"(c_custkey * {k + 3}) % 101") for k, n in enumerate(categories)}, weights)

    quality, opportunity = score("website_quality", seed.WEBSITE_QUALITY), score("business_opportunity", seed.BUSINESS_OPPORTUNITY)
    return table(spark, sf_dir, "customer").select("c_custkey", quality.alias("quality"), opportunity.alias("opportunity"))


@query("SELECT t AS score_type, CAST(s AS DECIMAL(12,4)) AS total, ok FROM (VALUES ('WEBSITE_QUALITY', 100, true), ('BUSINESS_OPPORTUNITY', 100, true), ('LEAD_PRIORITY', 1, true)) v(t, s, ok)")
def weight_sum_check(spark, sf_dir):
    rows = seed.scoring_versions(spark).withColumn("total", weight_sum(F.col("weights")))
    whole = F.when(F.col("score_type") == "LEAD_PRIORITY", F.lit(1)).otherwise(F.lit(100))
    return rows.select("score_type", "total", (F.col("total") == whole).alias("ok"))


@query(f"SELECT k AS key, 'boolean' AS type FROM (VALUES {_values([(k,) for k in expected.FLAGS])}) v(k)")
def settings_lookup(spark, sf_dir):
    return setting_rows(spark).where("is_feature_flag").select("key", "type")


@query("SELECT t AS score_type, CAST(v AS INTEGER) AS version, CAST(r AS BIGINT) AS type_rank FROM (VALUES ('WEBSITE_QUALITY', 1, 1), ('BUSINESS_OPPORTUNITY', 1, 2), ('LEAD_PRIORITY', 1, 3)) x(t, v, r)")
def active_version(spark, sf_dir):
    rows = seed.scoring_versions(spark).where("is_active")
    rank = enum_rank(F.col("score_type"), ENUMS["scoring_type"])
    return rows.select("score_type", "version", rank.cast("long").alias("type_rank")).orderBy("type_rank", "version")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'WEBSITE_QUALITY' WHEN 1 THEN 'BUSINESS_OPPORTUNITY' ELSE 'LEAD_PRIORITY' END AS score_type, 1::INTEGER AS version FROM customer")
def score_version_join(spark, sf_dir):
    names = F.array(*(F.lit(n) for n in ENUMS["scoring_type"]))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 3).cast("int")).alias("score_type"))
    versions = seed.scoring_versions(spark).where("is_active").select("score_type", "version")
    return rows.join(versions, "score_type").select("c_custkey", "score_type", "version")


# Histories, queues, schedules, metrics


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_per_key(spark, sf_dir):
    return lifecycle.latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id")


@query(
    "SELECT event_id, user_id, from_state, expected FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE before END AS from_state, before AS expected FROM"
    " (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) WHERE from_state IS DISTINCT FROM expected"
)
def transition_gaps(spark, sf_dir):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("from_state", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(before))
    return lifecycle.transition_gaps(rows, "user_id", "from_state", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "from_state", "expected")


@query("SELECT event_id, CAST(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS BIGINT) AS micros FROM events")
def time_in_state(spark, sf_dir):
    return lifecycle.time_in_state(table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"]).select("event_id", "micros")


@query(
    "WITH c AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) <= 1)"
    " SELECT day, event_id, user_id, CAST(row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS INTEGER) AS slot FROM c JOIN (SELECT event_id, ts FROM events) USING (event_id) QUALIFY slot <= 20"
)
def daily_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return lifecycle.daily_cap(rows, F.to_date("ts").cast("string"), "user_id", ["ts", "event_id"], 20, 1).select("day", "event_id", "user_id", "slot")


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 25")
def due_queue_topk(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    order = [F.asc_nulls_last("o_orderpriority"), F.asc_nulls_last("o_orderdate"), F.asc_nulls_last("o_orderkey")]
    return lifecycle.due_queue(orders, F.col("o_orderstatus") == "O", order, 25).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query(
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS metric_date, 'events' AS metric_name, '{\"type\": \"' || event_type || '\"}' AS dimension_key, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS value,"
    " count(*) AS n FROM events GROUP BY ALL"
)
def metrics_daily_rollup(spark, sf_dir):
    return metrics.daily_rollup(table(spark, sf_dir, "events"), F.to_date("ts"), F.lit("events"), F.create_map(F.lit("type"), F.col("event_type")), F.col("value")).withColumn("metric_date", F.col("metric_date").cast("string"))


@query(
    "SELECT event_id, CAST(s AS INTEGER) AS sequence_step, ts + to_days(CAST(d AS INTEGER)) AS scheduled_at FROM events, (VALUES (1, 3), (2, 10)) v(s, d)"
)
def followup_schedule(spark, sf_dir):
    offsets = seed.setting(setting_rows(spark), "outreach.followup.day_offsets")
    return lifecycle.followup_schedule(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", offsets).select("event_id", "sequence_step", "scheduled_at")


_LOCAL = "(ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago'"


@query(f"SELECT event_id FROM (SELECT event_id, {_LOCAL} AS t FROM events) WHERE isodow(t) BETWEEN 1 AND 5 AND hour(t) >= 9 AND hour(t) < 17")
def business_hours_filter(spark, sf_dir):
    rules = seed.setting(setting_rows(spark), "business.hours")
    return table(spark, sf_dir, "events").where(lifecycle.in_business_hours(F.col("ts").cast("timestamp"), rules)).select("event_id")


@query(
    "WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ts, event_id, CASE WHEN event_type = 'click' THEN 'followup' WHEN event_type = 'error' THEN 'other' ELSE 'outreach' END AS kind,"
    " user_id AS contact, user_id % 4 AS campaign_id, CASE user_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 END AS daily_limit FROM events),"
    " a AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY day, contact ORDER BY ts, event_id) <= 1),"
    " b AS (SELECT *, row_number() OVER (PARTITION BY day, campaign_id ORDER BY ts, event_id) AS n FROM a QUALIFY daily_limit IS NULL OR n <= daily_limit),"
    " c AS (SELECT day, event_id, kind, CAST(row_number() OVER (PARTITION BY day, kind ORDER BY ts, event_id) AS INTEGER) AS slot FROM b WHERE kind <> 'other')"
    " SELECT * FROM c WHERE slot <= CASE kind WHEN 'outreach' THEN 20 ELSE 25 END"
)
def send_limits(spark, sf_dir):
    limits = seed.setting(setting_rows(spark), "outreach.email.daily_limit")
    kind = F.when(F.col("event_type") == "click", "followup").when(F.col("event_type") == "error", "other").otherwise("outreach")
    rows = table(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("day"), "ts", "event_id", kind.alias("kind"), F.col("user_id").alias("contact"), (F.col("user_id") % 4).alias("campaign_id")
    )
    campaigns = spark.createDataFrame([(0, 2), (1, 4), (2, None)], "campaign_id long, daily_limit int")
    return lifecycle.send_limits(rows, limits, campaigns, ["ts", "event_id"]).select("day", "event_id", "kind", "slot")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'P' THEN 'now' ELSE 'daily' END AS told FROM orders"
)
def notification_rules(spark, sf_dir):
    rules = seed.setting(setting_rows(spark), "notifications.rules")
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "HIGH").otherwise("LOW")
    reply = F.when(F.col("o_orderstatus") == "P", "INTERESTED")
    return table(spark, sf_dir, "orders").select("o_orderkey", lifecycle.notified(priority, reply, rules).alias("told"))


@query("SELECT c_custkey, 150000 + 2900 * (c_custkey % 13) AS cents FROM customer")
def pricing_from_settings(spark, sf_dir):
    settings = setting_rows(spark)
    setup, hosting = (seed.setting(settings, f"pricing.{k}_cents") for k in ("website_setup_fee", "hosting_monthly"))
    return table(spark, sf_dir, "customer").select("c_custkey", lifecycle.price_cents(F.col("c_custkey") % 13, setup, hosting).alias("cents"))


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(round(CAST(o_totalprice AS DECIMAL(14,4)) * 100, 0) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_orderstatus")
def revenue_by_status(spark, sf_dir):
    cents = F.round(F.col("o_totalprice").cast("decimal(14,4)") * 100, 0).cast("long")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))


_PRICE = "CAST(round(CAST(o_totalprice AS DECIMAL(14,4)) * 100, 0) AS BIGINT)"
_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'WON' ELSE 'LOST' END"


@query(
    f"SELECT 1 AS step, 'opportunities' AS stage, {_STATUS} AS status, count(*) AS n, CAST(sum({_PRICE}) AS BIGINT) AS cents FROM orders GROUP BY ALL"
    " UNION ALL SELECT 2, 'customers', CASE WHEN c_acctbal < 0 THEN 'PAST_DUE' ELSE 'ACTIVE' END, count(*), CAST(0 AS BIGINT) FROM customer GROUP BY ALL"
    " UNION ALL SELECT 3, 'subscriptions', CASE WHEN c_acctbal < 0 THEN 'PAST_DUE' ELSE 'ACTIVE' END, count(*), CAST(count(*) * 2900 AS BIGINT) FROM customer GROUP BY ALL"
    " UNION ALL SELECT 4, 'payments', CASE l_returnflag WHEN 'R' THEN 'REFUNDED' ELSE 'SUCCEEDED' END, count(*), CAST(sum(CAST(round(CAST(l_extendedprice AS DECIMAL(14,4)) * 100, 0) AS BIGINT)) AS BIGINT) FROM lineitem GROUP BY ALL"
)
def revenue_funnel(spark, sf_dir):
    def cents(price: str):
        return F.round(F.col(price).cast("decimal(14,4)") * 100, 0).cast("long").alias("cents")

    o, c, li = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    status = F.when(F.col("c_acctbal") < 0, "PAST_DUE").otherwise("ACTIVE").alias("status")
    return metrics.revenue_funnel(
        o.select(F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "WON").otherwise("LOST").alias("status"), cents("o_totalprice")),
        c.select(status, F.lit(None).cast("long").alias("cents")),
        c.select(status, F.lit(2900).cast("long").alias("cents")),
        li.select(F.when(F.col("l_returnflag") == "R", "REFUNDED").otherwise("SUCCEEDED").alias("status"), cents("l_extendedprice")),
    )


@query(
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS metric_date, event_type AS metric_name, count(*) AS value,"
    " '{\"k\": {\"b\": 2.25, \"id\": [' || user_id || ', null, true]}, \"nth\": \"a\\\"b\"}' AS dimension_key FROM events GROUP BY ts::DATE, event_type, user_id"
)
def write_metrics_unique(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("metric_date"), F.col("event_type").alias("metric_name"), "user_id").agg(F.count("*").cast("decimal(14,2)").alias("value"))
    text = F.concat(F.lit('{"nth": "a\\"b", "k": {"id": ['), F.col("user_id").cast("string"), F.lit(', null, true], "b": 2.25}}'))
    new = rows.select("metric_date", "metric_name", "value", F.parse_json(text).alias("dimension"))
    none = warehouse.read(spark, model(spark, "metrics"), "metrics")
    unique = ["metric_date", "metric_name", "dimension_key"]
    once = warehouse.stored(writer.inserted("metrics", none, new, unique), "metrics")
    twice = writer.inserted("metrics", once, new.withColumn("value", F.col("value") + 1), unique)
    made = writer.write("metrics", twice, f"{warehouse.shared_folder(spark)}/metrics-{uuid.uuid4().hex}")
    return made.select(F.col("metric_date").cast("string").alias("metric_date"), "metric_name", F.col("value").cast("long").alias("value"), "dimension_key")


_REPORT = (
    [(f"table {t}", True, "found") for t in expected.TABLES] + [("number of tables", True, "27")] + [(f"enum {e}", True, "found") for e, _ in _ENUM_ROWS]
    + [(f"index {n}", True, "found") for n in expected.CHECKED_INDEXES] + [(f"constraint {n}", True, "found") for n in expected.CHECKED_CONSTRAINTS]
    + [(f"check {n}", True, "found") for n in expected.CHECKED_CHECKS] + [("settings", True, "17"), ("scoring versions", True, "3")]
    + [("active score types", True, "WEBSITE_QUALITY, BUSINESS_OPPORTUNITY, LEAD_PRIORITY")]
)


@query(f"SELECT n AS name, ok, d AS detail FROM (VALUES {_values(_REPORT)}) v(n, ok, d)")
def verify_report(spark, sf_dir):
    return verification.report(spark, model(spark))


@query("SELECT CAST(86 AS BIGINT) AS checks, CAST(0 AS BIGINT) AS failures, true AS passed")
def verify_summary(spark, sf_dir):
    return verification.summary(verification.report(spark, model(spark)))
