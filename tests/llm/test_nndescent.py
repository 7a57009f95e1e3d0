import numpy as np
import pytest

from leadloom.llm import nndescent
from leadloom.llm.nndescent import near_vectors
from tests.llm.conftest import Union


def brute(rows, threshold=0.93):
    def usable(r):
        x = r[1]
        return r[0] is not None and r[2] is not None and x is not None and all(c is not None and np.isfinite(c) for c in x) and any(x)

    own = [k for k, r in enumerate(rows) if usable(r)]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in own}
    n, u = [0] * len(rows), Union(len(rows))
    for a in own:
        for b in own:
            if a < b and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                n[b] += 1
                u.join(a, b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[u.find(k)] = min(r[0], least.get(u.find(k), r[0]))
    return sorted(((r[0] is None, r[0] or 0, n[k], None if r[0] is None else least[u.find(k)]) for k, r in enumerate(rows)), key=str)


def test_groups_of_all_sizes_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for size in (1, 1, 2, 2, 3, 5, 12, 40, 120):
        centre = rng.standard_normal(16)
        rows += [(len(rows) + k, (centre + rng.standard_normal(16) * rng.choice([0.05, 0.25])).tolist(), int(size > 20 and k % 2)) for k in range(size)]
    rows += [(k + len(rows), rng.standard_normal(16).tolist(), k % 2) for k in range(200)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, rows[0][1], None), (None, rows[0][1], 0), (n + 4, [None] * 16, 0), (3, rows[3][1], 0)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in out), key=str)
    assert got == brute(rows)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in out)


def test_links_that_descent_loses_are_found_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "AUDIT", 4)
    monkeypatch.setattr(nndescent, "ENLARGEMENTS", 0)
    monkeypatch.setattr(nndescent, "_descend", lambda graph, *rest: graph.where("s < 0.5"))
    monkeypatch.setattr(nndescent, "SUPER", 3)
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(16).tolist(), k % 2) for k in range(150)]
    rows += [(150 + k, (np.array(rows[k // 2][1]) + 0.05 * rng.standard_normal(16)).tolist(), rows[k // 2][2]) for k in range(12)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((False, r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str) == brute(rows)
    assert sum(r["n_links"] for r in out) > 0


def test_equal_vectors_and_blocks_of_many(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 8)
    monkeypatch.setattr(nndescent, "SUPER", 2)
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(12)
    rows = [(k, (centre + 0.05 * rng.standard_normal(12)).tolist(), 0) for k in range(60)]
    rows += [(100 + k, rows[k % 3][1], 0) for k in range(30)] + [(200 + k, rows[4][1], 1) for k in range(3)] + [(300 + k, [0.0] * 12, 0) for k in range(2)]
    rows += [(400, (2 * np.array(rows[5][1])).tolist(), 0), (401, [-c for c in rows[5][1]], 0)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((False, r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str) == brute(rows)


def test_a_tight_group_is_counted_without_products(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    monkeypatch.setattr(nndescent, "SUPER", 2)
    taken, own = [], nndescent._dense

    def counted(packed, *rest):
        taken.append(packed.count())
        return own(packed, *rest)

    monkeypatch.setattr(nndescent, "_dense", counted)
    monkeypatch.setattr(nndescent, "_block_links", lambda dims, threshold: lambda batches: iter(()))
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(12)
    rows = [(k, (centre + 0.01 * rng.standard_normal(12)).tolist(), 0) for k in range(150)] + [(150 + k, rows_[1], 0) for k, rows_ in enumerate([(0, (centre + 0.01).tolist())] * 5)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert taken[0] > 100 and sorted(((False, r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str) == brute(rows)


@pytest.mark.parametrize("kind", ["no links", "all saturated"])
def test_the_audit_has_a_bounded_number_of_jobs(spark, monkeypatch, kind):
    monkeypatch.setattr(nndescent, "AUDIT", 20)
    monkeypatch.setattr(nndescent, "AUDITED", 300)
    slices, own = [], nndescent._slice_links
    monkeypatch.setattr(nndescent, "_slice_links", lambda *a: slices.append(1) or own(*a))
    rng, used = np.random.default_rng(3), []
    for n in (500, 1500):
        slices.clear()
        x = rng.standard_normal((n, 24)) if kind == "no links" else rng.standard_normal(24) + 0.01 * rng.standard_normal((n, 24))
        rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
        out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        used.append(len(slices))
        assert {r["n_links"] for r in out} == ({0} if kind == "no links" else {n - 1})
    assert used[0] == used[1] <= 4


def test_clashing_columns(spark):
    rows = [(k, [1.0, 0.1 * k], 0, 7, 8, 9) for k in range(4)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int, k1 int, copies int")).collect()
    assert sorted(((False, r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str) == brute([r[:3] for r in rows])


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(df).collect() == []
