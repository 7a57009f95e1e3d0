import numpy as np

from leadloom.llm import components as module
from leadloom.llm.components import components
from tests.llm.conftest import Union


def test_paths_stars_and_noise(spark):
    rng = np.random.default_rng(0)
    path = rng.permutation(300)
    edges = [(int(a), int(b)) for a, b in zip(path, path[1:])] + [(1000 + k, 1001 + k) for k in range(200)] + [(2000, 2001 + k) for k in range(300)]
    edges += [(3000 + int(a), 3000 + int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(5, 5), (5, 5)]
    u = Union(4000)
    for a, b in edges:
        u.join(a, b)
    least = {}
    for x in sorted({x for e in edges for x in e if e[0] != e[1]}):
        least.setdefault(u.find(x), x)
    want = {x: least[u.find(x)] for e in edges for x in e if e[0] != e[1]}
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_a_sorted_chain_takes_few_rounds(spark, monkeypatch):
    rounds, own = [], module._nearest
    monkeypatch.setattr(module, "_nearest", lambda links, k: rounds.append(k) or own(links, k))
    chain = spark.range(10_000).selectExpr("id AS a", "id + 1 AS b")
    out = components(chain)
    assert out.count() == 10_001 and out.where("component <> 0").count() == 0
    assert len(rounds) < 20


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
