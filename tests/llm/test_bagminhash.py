from collections import Counter, defaultdict

import numpy as np

from leadloom.llm.bagminhash import near_duplicates, signatures
from leadloom.llm.textblocks import mix
from tests.llm.conftest import Union, words


def brute(rows):
    rows = [r for r in rows if r["doc_id"] is not None and words(r["text"])]
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    at = defaultdict(set)
    for k, s in enumerate(sets):
        for x in s:
            at[x].add(k)
    u = Union(len(rows))
    for a, b in {(a, b) for s in at.values() for a in s for b in s if a < b}:
        if sum((sets[a] & sets[b]).values()) * 10 >= sum((sets[a] | sets[b]).values()) * 8:
            u.join(a, b)
    ids = {}
    for k, r in enumerate(rows):
        ids.setdefault(u.find(k), []).append(r["doc_id"])
    return {r["doc_id"]: min(ids[u.find(k)]) for k, r in enumerate(rows)}


def test_equals_brute_force(docs):
    out = near_duplicates(docs).collect()
    assert len(out) == docs.count()
    got, want = {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None}, brute(docs.collect())
    assert {k: got[k] for k in want} == want
    assert all(got[k] == k for k in got if k not in want)


def test_near_copies_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(60):
        w = list(base)
        for i in rng.choice(150, rng.integers(0, 9), replace=False):
            w[i] = f"e{rng.integers(30)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()} == brute(df.collect())


def test_signatures_estimate_weighted_jaccard():
    key = mix(np.arange(1, 61, dtype=np.uint64))
    a, b = np.arange(60) % 7 + 1, np.arange(60) % 5 + 1
    doc = np.repeat([0, 1], 60)
    sig = signatures(doc, np.concatenate([key, key]), np.concatenate([a, b]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_empty(empty):
    assert near_duplicates(empty).collect() == []


def test_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, 5, 6, 7), (2, text + " more", 5, 6, 7), (3, "another text of its own here", 5, 6, 7)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node int, weight int, k1 int"))
    assert sorted((r["doc_id"], r["class_id"], r["kept"]) for r in out.collect()) == [(1, 1, True), (2, 1, False), (3, 3, True)]
