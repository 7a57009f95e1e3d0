from collections import defaultdict

from leadloom.llm import mixing, queries
from tests.conftest import SF, same
from tests.llm.conftest import words


def test_equals_its_sql(spark, duck):
    same(queries.QUERIES["op1_source_mixing"](spark, SF), duck.sql(queries.ORACLES["op1_source_mixing"]))


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 5), ("d1", "en", "d", 1000)], "domain string, lang string, source string, capacity long")
    out = {r["source"]: r["budget"] for r in mixing.budgets(leaves, mixing.F.lit(400).cast("long"), weights={"domain": {"d0": 1, "d1": 1}}).collect()}
    # d0 has 200: its de leaf takes 5, en 195, of which a takes its 10 and b what a cannot.
    assert out == {"a": 10, "b": 185, "c": 5, "d": 200}


def test_budget_is_met_exactly_and_each_leaf_is_a_prefix(docs):
    out = mixing.mix(docs, per_mille=700, epochs=2).collect()
    tokens = sum(len(words(r["text"])) for r in docs.collect())
    assert sum(r["take_tokens"] for r in out) == tokens * 700 // 1000
    cut = defaultdict(int)
    for r in out:
        assert 0 < r["take_tokens"] <= r["n_tokens"] and r["epoch"] < 2
        cut[r["domain"], r["lang"], r["source"]] += r["take_tokens"] < r["n_tokens"]
    assert max(cut.values()) <= 1
    assert mixing.mix(docs, per_mille=700).exceptAll(mixing.mix(docs, per_mille=700)).count() == 0


def test_texts_are_cut_after_their_tokens(docs):
    out = mixing.texts(docs, per_mille=1300, epochs=3).collect()
    tokens = sum(len(words(r["text"])) for r in docs.collect())
    assert sum(len(words(r["text"])) for r in out) == tokens * 1300 // 1000
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.collect()}


def test_equal_rows_are_cut_once(spark):
    rows = [(1, "a b c d", "en", "x")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sorted(r["text"] for r in mixing.texts(df, per_mille=500, epochs=1).collect())
    assert out == ["a b", "a b c d", "a b c d"]


def test_clashing_columns(spark):
    rows = [(1, " a b", "en", "x", 9, "c", 5, 6, "p"), (2, "c d e", None, None, 8, "c", 5, 6, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _doc int, _content string, nth int, doc int, passes string")
    out = sorted(tuple(r) for r in mixing.texts(df, per_mille=1000, epochs=1).collect())
    assert out == sorted(rows)


def test_empty_and_null(empty, spark):
    assert mixing.mix(empty).collect() == [] and mixing.texts(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None, None), (2, " ", "en", "x")], "doc_id long, text string, lang string, source string")
    assert mixing.mix(blank).collect() == []
