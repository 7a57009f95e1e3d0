import pytest
from pyspark.sql.types import DecimalType, VariantType

from leadloom.operators import verification
from leadloom.plans import catalogue
from leadloom.sources import seed, warehouse
from leadloom.sources.registry import ENUMS, foreign_keys, load_order, tables


def test_sizes():
    t = tables()
    assert (len(t), sum(len(x.columns) for x in t.values()), len(ENUMS), sum(map(len, ENUMS.values()))) == (27, 268, 28, 135)
    assert (len(foreign_keys()), sum(len(x.indexes) for x in t.values())) == (29, 53)
    assert (sum(len(x.uniques) for x in t.values()), sum(len(x.checks) for x in t.values())) == (9, 13)
    assert sum(c.required for x in t.values() for c in x.columns) == 153
    assert sum(c.default is not None for x in t.values() for c in x.columns) == 103


def test_schema_and_order():
    s = tables()["lead_scores"].schema
    assert s["market_fit_score"].dataType == DecimalType(5, 2) and s["formula_fields"].dataType == VariantType()
    assert s["classification"].metadata == {"enum": "lead_classification"} and not s["business_id"].nullable
    assert [len(x) for x in load_order()] == [8, 7, 7, 4, 1]


def test_report_of_the_seeded_model(spark):
    checks = verification.report(spark, catalogue.model(spark))
    rows = checks.collect()
    assert len(rows) == 86 and all(r["ok"] for r in rows)
    assert tuple(verification.summary(checks).first()) == (86, 0, True)


def test_report_fails_where_a_table_or_rows_are_missing(spark, tmp_path):
    root = f"file://{tmp_path}/model"
    warehouse.create(spark, root, [t for t in tables() if t not in ("contacts", "lead_scores")])
    failed = {r["name"] for r in verification.report(spark, root).where("not ok").collect()}
    assert {"table contacts", "table lead_scores", "number of tables", "settings", "scoring versions", "active score types", "check chk_lead_scores_wsq"} <= failed
    assert {"enum contact_status", "index idx_lead_scores_priority", "constraint contacts_business_id_businesses_id_fk"} <= failed
    assert "table websites" not in failed and "constraint u_websites_url" not in failed
    assert verification.summary(verification.report(spark, root)).first()["failures"] == len(failed)


def test_a_table_less_in_the_model_differs_from_the_sql(spark, duck, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/model"
    warehouse.create(spark, root, [t for t in tables() if t != "tasks"])
    monkeypatch.setattr(catalogue, "model", lambda spark: root)
    for name in ("catalog_tables", "catalog_indexes", "catalog_enums_join", "catalog_constraints_join"):
        assert len(duck.sql(catalogue.ORACLES[name]).fetchall()) > catalogue.QUERIES[name](spark, "").count()


def test_settings_are_typed_and_described(spark):
    rows = {r["key"]: r for r in seed.settings(spark).collect()}
    assert len(rows) == 17 and all(r["description"] for r in rows.values())
    assert seed.setting(seed.settings(spark), "pricing.hosting_monthly_cents") == 2900
    assert seed.settings(spark).schema["value"].dataType == VariantType()
    with pytest.raises(KeyError):
        seed.setting(seed.settings(spark), "none")


def test_membership_missing(spark):
    want = spark.createDataFrame([("a",), ("b",)], "n string")
    got = verification.membership(want, spark.createDataFrame([("a",), ("a",)], "n string"), "n").collect()
    assert {r["n"]: r["ok"] for r in got} == {"a": True, "b": False}
