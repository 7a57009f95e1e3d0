"""The verification report: what must exist, looked up in what does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import enum_rank
from ..sources import catalog, warehouse
from ..sources.registry import ENUMS

# The tables, enums, indexes, constraints and checks that must exist.
TABLES = """
audit_logs businesses contacts conversation_messages conversations customer_onboarding customers demos domains exceptions followups lead_scores
lead_state_history metrics outreach_campaigns outreach_messages payments production_websites sales_opportunities scoring_versions subscriptions
system_settings tasks templates website_analyses website_versions websites
""".split()
ENUM_NAMES = """
audit_actor_type business_operational_status campaign_status contact_status conversation_status customer_status demo_status domain_status
exception_priority exception_status followup_status lead_classification lead_lifecycle_state message_direction message_status onboarding_status
opportunity_status payment_status production_website_status reply_classification scoring_type subscription_interval subscription_status task_status
template_type website_classification website_status website_version_status
""".split()
INDEXES = """
idx_businesses_lifecycle_state idx_businesses_state_city idx_businesses_source idx_outreach_messages_campaign_id idx_outreach_messages_status
idx_followups_status_scheduled_at idx_audit_logs_entity idx_audit_logs_created_at idx_tasks_status_scheduled_at idx_exceptions_status_priority
idx_website_analyses_analyzed_at idx_lead_scores_priority idx_lead_scores_classification
""".split()
CONSTRAINTS = """
contacts_business_id_businesses_id_fk lead_scores_scoring_version_scoring_versions_id_fk website_analyses_analysis_version_scoring_versions_id_fk
outreach_messages_campaign_id_outreach_campaigns_id_fk followups_outreach_message_id_outreach_messages_id_fk
u_websites_url u_metrics_date_name_dim u_customers_business_id u_scoring_versions_type_version u_website_versions_site_number
""".split()
CHECKS = "chk_businesses_contactability chk_lead_scores_wsq chk_lead_scores_bos chk_lead_scores_priority".split()


def membership(expected: DataFrame, actual: DataFrame, name: str) -> DataFrame:
    """(name, ok): each expected name and whether it is among the actual ones."""
    found = actual.select(F.col(name).alias("_found")).distinct()
    return expected.join(found, expected[name] == F.col("_found"), "left").select(name, F.col("_found").isNotNull().alias("ok"))


def report(spark: SparkSession, root: str) -> DataFrame:
    """Checks (name, ok, detail) of what is stored in ``root``: the names above against the catalog of its tables, and its rows."""

    def names(kind: str, listed: list[str], actual: DataFrame, column: str) -> DataFrame:
        expected = spark.createDataFrame([(n,) for n in listed], f"{column} string")
        return membership(expected, actual, column).select(F.concat(F.lit(f"{kind} "), column).alias("name"), "ok", F.when(F.col("ok"), "found").otherwise("missing").alias("detail"))

    def count(name: str, rows: DataFrame, least: int, most: int | None) -> DataFrame:
        n = F.count("*")
        ok = (n >= least) if most is None else n.between(least, most)
        return rows.agg(F.lit(name).alias("name"), ok.alias("ok"), n.cast("string").alias("detail"))

    def rows(name: str, columns: str) -> DataFrame:
        found = warehouse.read(spark, root, name)
        return found if found is not None else spark.createDataFrame([], columns)

    listed, constraints = catalog.info_tables(spark, root), catalog.info_constraints(spark, root)
    versions = rows("scoring_versions", "score_type string, is_active boolean")
    active = versions.where("is_active").select("score_type", enum_rank(F.col("score_type"), ENUMS["scoring_type"]).alias("rank")).distinct()
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score_type"))), lambda x: x["score_type"])
    parts = [
        names("table", TABLES, listed, "table_name"),
        count("number of tables", listed, len(TABLES), len(TABLES)),
        names("enum", ENUM_NAMES, catalog.info_enums(spark, root), "type_name"),
        names("index", INDEXES, catalog.info_indexes(spark, root), "index_name"),
        names("constraint", CONSTRAINTS, constraints, "constraint_name"),
        names("check", CHECKS, constraints, "constraint_name"),
        count("settings", rows("system_settings", "key string"), 10, None),
        count("scoring versions", versions, 3, 3),
        active.agg(F.lit("active score types").alias("name"), (F.count("*") == 3).alias("ok"), F.array_join(in_order, ", ").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def summary(checks: DataFrame) -> DataFrame:
    """(checks, failures, passed): how many checks failed, and whether none did."""
    return checks.agg(F.count("*").alias("checks"), F.count_if(~F.col("ok")).alias("failures"), (F.count_if(~F.col("ok")) == 0).alias("passed"))


def value_text(value: Column) -> Column:
    """Objects and arrays as JSON text, other JSON values as plain text."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value)).otherwise(F.variant_get(value, "$", "string"))


def settings_dump(settings: DataFrame) -> DataFrame:
    """(key, type, text) of all settings, by key."""
    return settings.select("key", "type", value_text(F.col("value")).alias("text")).orderBy(F.asc_nulls_last("key"))
