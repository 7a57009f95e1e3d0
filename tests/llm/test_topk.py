import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import queries, topk
from leadloom.llm.topk import top_inner_products
from tests.conftest import SF, same


def test_equals_its_sql(spark, duck):
    same(queries.QUERIES["op5_norm_sorted_topk"](spark, SF), duck.sql(queries.ORACLES["op5_norm_sorted_topk"]))


def test_many_blocks_of_different_lengths(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 8)) * rng.exponential(1, (700, 1)) ** 2
    x[100:140] = x[100]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = np.floor(64 * x).astype(int)
    want = set()
    for q in range(0, 700, 20):
        s = v @ v[q]
        order = sorted((k for k in range(700) if k != q), key=lambda k: (-s[k], k))[:20]
        want |= {(q, i + 1, k, int(s[k])) for i, k in enumerate(order)}
    assert {tuple(r) for r in top_inner_products(df, block=64).collect()} == want


def expected(rows, every=20):
    """Brute force with a row number for each row, so that repeated ids are rows of their own."""
    v = [(k, np.floor(64 * np.array(x)).astype(object)) for k, x in rows]
    out = []
    for i, (q, x) in enumerate(v):
        if q % every == 0:
            best = sorted((-(x @ y), k) for j, (k, y) in enumerate(v) if j != i)[:20]
            out += [(q, n + 1, k, int(-s)) for n, (s, k) in enumerate(best)]
    return sorted(out)


def test_repeated_ids_ties_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 70, rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(210)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, row int, band int, score int")
    assert sorted(tuple(r) for r in top_inner_products(df, block=16).collect()) == expected(rows)


def test_large_components_are_exact_or_refused(spark):
    rows = [(0, [2.0**24, 1.0]), (1, [2.0**23 + 0.25, -3.0]), (2, [-(2.0**24), 2.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_inner_products(df).collect()) == expected(rows)
    huge = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="do not fit"):
        top_inner_products(huge)


def test_blocks_out_of_reach_are_not_fetched(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 8))
    x[150:] *= 0.01
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    fetched, own = [], topk.open_pairs

    def counted(queries, blocks, low, high):
        out = own(queries, blocks, low, high)
        fetched.append((low, out.count(), queries.count() * (high - low) * 4))
        return out

    monkeypatch.setattr(topk, "open_pairs", counted)
    got = sorted(tuple(r) for r in top_inner_products(df, block=32).collect())
    assert got == expected(list(enumerate(x.tolist())))
    assert len(fetched) > 2 and sum(n for _, n, _ in fetched) < 0.6 * sum(n for _, _, n in fetched)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0]), (6, [1.0]), (None, [9.0, 9.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_inner_products(df).orderBy("rank").collect()] == [(0, 1, 7, 64 * 64 * 5), (0, 2, 6, 64 * 64), (0, 3, 5, 0)]
    assert top_inner_products(df.where("false")).collect() == [] and top_inner_products(df.where("vec_id = 1")).collect() == []
    assert top_inner_products(df, is_query=F.col("vec_id") == 99).collect() == []
