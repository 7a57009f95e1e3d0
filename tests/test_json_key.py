import json
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.functions.ordering import json_key

_ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def plain(value):
    """The text by Python's own reader: keys by length in bytes, then bytes; numbers in plain digits as they were written."""
    if isinstance(value, dict):
        return "{" + ", ".join(f"{plain(k)}: {plain(value[k])}" for k in sorted(value, key=lambda k: (len(k.encode()), k.encode()))) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(plain, value)) + "]"
    if isinstance(value, Decimal):
        return format(abs(value) if not value else value, "f")
    if isinstance(value, str):
        return '"' + "".join("\\" + c if c in '"\\' else _ESCAPES.get(ord(c), f"\\u{ord(c):04x}") if c < " " else c for c in value) + '"'
    return {None: "null", True: "true", False: "false"}[value] if value is None or isinstance(value, bool) else str(value)


def want(text):
    return None if text is None else plain(json.loads(text, parse_float=Decimal))


def got(spark, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(json_key(F.col("t"))).collect()]


TEXTS = [
    "{}", "[]", "[[],{},[{}]]", "null", "true", '""', '"{[,:]}\\""', "0", "-0", "-0.00", "1.50", "1e3", "-1.5E3", "1.50e1", "0.05e1", "1e-7", "12.5e-3", "0.00e-1", "0.0e5", "123456789012345678901234567890.10",
    '{"b":1,"a":2,"aa":{"z":[1,{"y":[]}],"é":"\\u00e9\\/\\n\\u0001"}}', '{"a":1,"a":2}', '{"a":{"x":1},"b":3,"a":{"y":[{"q":1,"p":2}]}}', ' { "k" : [ 1 , 2.0 , { "b" : null , "a" : "x y" } ] } ',
    '{"":"","\\"":1,"\\\\":2,"":""}', '[1,[2,[3,[4,[5,[6,[7,[8,[9,{"k":[10]}]]]]]]]]]', '{"😀":"👍","ab":"","zz":[true,false,null]}', None,
]


def test_equals_pythons_reader(spark):
    long = ["[" * 60 + "]" * 60, json.dumps({"k": 'x\\"' * 30000}), json.dumps([{"b": k, "a": [k]} for k in range(2000)])]
    assert got(spark, TEXTS + long) == [want(t) for t in TEXTS + long]


JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(st.characters(exclude_categories=["Cs"]), max_size=6) | st.floats(allow_nan=False, allow_infinity=False),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("ab\"\\{}[],:é", max_size=3), x, max_size=4),
    max_leaves=20,
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(JSON, min_size=40, max_size=60))
def test_any_nesting(spark, values):
    texts = [json.dumps(v, ensure_ascii=k % 2 == 0, indent=k % 3 or None) for k, v in enumerate(values)]
    assert got(spark, texts) == [want(t) for t in texts]


def test_runs_in_the_jvm_and_refuses_other_text(spark):
    df = spark.createDataFrame([("{",)], "t string")
    plan = df.select(json_key(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") or "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    with pytest.raises(Exception, match="MALFORMED"):
        got(spark, ["{"])
