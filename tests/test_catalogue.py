import pytest

from leadloom.plans import operations as catalogue
from tests.conftest import SF, same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLES[name]))


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_k_plan_and_pushed_filter(spark):
    plan = catalogue.QUERIES["due_queue_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_orderstatus,O)" in plan
