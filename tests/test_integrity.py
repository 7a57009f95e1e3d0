from decimal import Decimal

from leadloom.operators import integrity
from leadloom.sources.registry import ENUMS


def values(df, column):
    return sorted(r[column] for r in df.collect())


def test_ranges_pass_on_null(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 100, -1, 101, None)], "s int")
    assert values(integrity.check_violations(rows, "s BETWEEN 0 AND 100"), "s") == [-1, 101]
    cents = spark.createDataFrame([(x,) for x in (1, 0, -5, None)], "c int")
    assert values(integrity.check_violations(cents, "c > 0"), "c") == [-5, 0]


def test_domain(spark):
    rows = spark.createDataFrame([(x,) for x in ("ACTIVE", "active", "", None, "CANCELLED")], "s string")
    assert values(integrity.domain_violations(rows, "s", ENUMS["subscription_status"]), "s") == ["", "CANCELLED", "active"]


def test_unique_and_reference(spark):
    rows = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in integrity.unique_violations(rows, ["k"]).collect()] == [(1, 2)]
    parent = spark.createDataFrame([(1,)], "id int")
    assert values(integrity.reference_violations(rows, "k", parent), "k") == [2]


def test_whole_table(spark):
    rows = spark.createDataFrame(
        [("a", "b1", 40, 70, Decimal("61.25"), None, "REVIEW"), ("a", None, 101, 70, None, Decimal("-1"), "review")],
        "id string, business_id string, website_quality_score int, business_opportunity_score int, market_fit_score decimal(5,2), lead_priority_score decimal(5,2), classification string",
    ).selectExpr("*", "parse_json(null) formula_fields", "string(null) scoring_version", "current_timestamp() created_at")
    found = {r["constraint_name"]: r["n"] for r in integrity.validate("lead_scores", rows, {"businesses": spark.createDataFrame([("b2",)], "id string")}).collect()}
    assert found == {
        "lead_scores.business_id not null": 1, "chk_lead_scores_wsq": 1, "chk_lead_scores_priority": 1, "lead_scores.classification domain": 1,
        "lead_scores_pkey": 1, "lead_scores_business_id_businesses_id_fk": 1,
    }
