import pytest

from leadloom.operators import dml


def test_insert_or_ignore_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    batch = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 5), (None, 5)], "k string, v int")
    once = dml.insert_or_ignore(old, batch, ["k"])
    assert sorted(once.collect(), key=str) == sorted([("a", 1), ("b", 2), (None, 5), (None, 5)], key=str)
    keyed = batch.where("k is not null")
    assert sorted(dml.insert_or_ignore(once, keyed, ["k"]).collect(), key=str) == sorted(once.collect(), key=str)


def state(spark):
    def rows(data, schema):
        return spark.createDataFrame(data, schema)

    return {
        "businesses": rows([("b1",), ("b2",)], "id string"),
        "customers": rows([("c1", "b1"), ("c2", "b2")], "id string, business_id string"),
        "contacts": rows([("p1", "b1"), ("p2", "b2")], "id string, business_id string"),
        "outreach_messages": rows([("m1", "b2", "p1"), ("m2", "b2", None)], "id string, business_id string, contact_id string"),
        "followups": rows([("f1", "m1"), ("f2", "m2")], "id string, outreach_message_id string"),
        "sales_opportunities": rows([("s1", "b1", "b1"), ("s2", "b2", "b1")], "id string, business_id string, source_lead_id string"),
    }


def test_cascade_set_null_and_mixed(spark):
    after = dml.delete_cascade(state(spark), "businesses", spark.createDataFrame([("b1",)], "id string"))
    got = {t: sorted(tuple(r) for r in df.collect()) for t, df in after.items()}
    assert got["businesses"] == [("b2",)] and got["contacts"] == [("p2", "b2")]
    assert got["customers"] == [("c1", None), ("c2", "b2")]
    assert got["outreach_messages"] == [("m2", "b2", None)] and got["followups"] == [("f2", "m2")]
    assert got["sales_opportunities"] == [("s2", "b2", None)]


def test_restrict(spark):
    s = {"scoring_versions": spark.createDataFrame([("v1",)], "id string"), "lead_scores": spark.createDataFrame([("l", "b", "v1")], "id string, business_id string, scoring_version string")}
    with pytest.raises(ValueError, match="restricts"):
        dml.delete_cascade(s, "scoring_versions", s["scoring_versions"])


def test_defaults_fill_omitted_columns_only(spark):
    rows = spark.createDataFrame([("x", "i", "s")], "business_name string, industry string, source string")
    r = dml.with_defaults("businesses", rows).first()
    assert r["business_status"] == "UNKNOWN" and r["lifecycle_state"] == "DISCOVERED" and len(r["id"]) == 36
    null = dml.with_defaults("businesses", rows.selectExpr("*", "string(null) business_status")).first()
    assert null["business_status"] is None
    assert dml.with_defaults("businesses", rows).first()["id"] == r["id"]


def test_generated_key(spark):
    rows = spark.createDataFrame([({"b": "1", "aa": "2"},), ({"aa": "2", "b": "1"},), ({},), (None,), ({'q"': None},)], "dimension map<string,string>")
    keys = [r["dimension_key"] for r in dml.with_dimension_key(rows).collect()]
    assert keys == ['{"b": "1", "aa": "2"}', '{"b": "1", "aa": "2"}', "{}", None, '{"q\\"": null}']
    with pytest.raises(ValueError):
        dml.with_dimension_key(rows.selectExpr("*", "'x' dimension_key"))
