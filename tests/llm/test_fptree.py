import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from leadloom.llm import fptree
from tests.conftest import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """Documents (id, text) and items (id, text) -> all rankings by scoring everything."""
    held = [(d, Counter(t), len(t)) for d, t in ((d, terms(x)) for d, x in docs)]
    n_docs, n_all = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for d, c, n in held:
            m = 75 + (25 * n * n_docs) // max(1, n_all)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return Counter(out)


def made(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def tables(spark, docs):
    odd = [(1007, None), (1008, ""), (9, "THE the The  é É"), (9, "THE the The  é É"), (9, "zz q"), (None, "zz"), (1010, "qqzzx.zzqqx"), (11, "der " * 400 + "word q"), (12, "a_b c9,9c\x00日本語")]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame(odd, "item_id long, text string"))
    return docs, items.cache()


def test_equals_brute_force(tables):
    docs, items = tables
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert made(fptree.ranked(docs, items)) == want and len(want) > 100


def test_blocks_of_items_and_small_trees(tables, monkeypatch):
    docs, items = tables
    want = made(fptree.ranked(docs, items, 3))
    for name, value in (("ITEM_TERMS", 40), ("TREE_DOCS", 8)):
        monkeypatch.setattr(fptree, name, value)
    assert made(fptree.ranked(docs.limit(10**9), items, 3)) == want


def random_block(dice, n, n_terms):
    rows = []
    for k in range(n):
        if rows and dice.random() < 0.4:  # copies, and texts that share a beginning
            own = dict(list(dice.choice(rows).items())[: dice.randint(1, 30)])
        else:
            own = {t: dice.choice([1, 1, 2, 5]) for t in range(n_terms) if dice.random() < 1.5 / (t + 1) + 0.05}
        rows.append(own or {0: 1})
    counts = np.array([len(r) for r in rows])
    flat = [np.array([x for r in rows for x in pick(r)], np.int64) for pick in (dict.keys, dict.values)]
    return fptree.tree(np.array(dice.sample(range(9 * n), n)), np.array([dice.randint(75, 200) for _ in rows]), counts, *flat, n_terms)


def scores(t, item, ws):
    out = np.zeros(len(t.doc_ids), np.int64)
    for k in range(len(out)):
        own = dict(zip(t.terms[t.first[k] : t.first[k + 1]].tolist(), t.tfs[t.first[k] : t.first[k + 1]].tolist()))
        out[k] = sum(w * ((10**9 * own[x]) // (1000 * own[x] + 12 * int(t.doc_m[k]))) for x, w in zip(item, ws) if x in own)
    return out


def test_tree_bounds_and_pruning():
    """Every node holds the maxima and minima of its documents, the search equals all scores, and most nodes stay shut."""
    dice = random.Random(4)
    opened = nodes = 0
    for n in (1, 2, 7, 60, 900):
        t = random_block(dice, n, 25)
        held = {k: v for k, v in zip(t.keys.tolist(), t.most.tolist())}
        for node in range(t.nodes):
            own = slice(t.low[node], t.high[node])
            assert t.m[node] == t.doc_m[own].min() and t.ids[node] == t.doc_ids[own].min()
            at = slice(t.first[t.low[node]], t.first[t.high[node]])
            most = Counter()
            for x, tf in zip(t.terms[at].tolist(), t.tfs[at].tolist()):
                most[x] = max(most[x], tf)
            assert most == {x: held[x * t.nodes + node] for x in range(25) if x * t.nodes + node in held}
        for _ in range(20):
            item = sorted(dice.sample(range(25), dice.randint(1, 8)))
            ws = [dice.randint(1, 9000) for _ in item]
            best = fptree.Best(5)
            opened += fptree.search(t, np.array(item), np.array(ws), best)
            nodes += t.nodes
            every = sorted((-s, d) for s, d in zip(scores(t, item, ws).tolist(), t.doc_ids.tolist()) if s > 0)[:5]
            assert list(zip((-best.scores).tolist(), best.ids.tolist())) == every
    assert opened < nodes / 3


def test_nodes_are_opened_in_waves():
    """Some nodes at a time, so that a search takes far fewer steps than it opens nodes; an item of many terms opens fewer at a time."""
    dice = random.Random(5)
    t = random_block(dice, 900, 25)
    item, ws = np.arange(25), np.arange(1, 26)
    for limit in (fptree.WAVE_TERMS, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(fptree, "WAVE_TERMS", limit)
            asked = []
            best = fptree.Best(300)
            patch.setattr(best, "open", lambda s, i: asked.append(len(s)) or fptree.Best.open(best, s, i))
            opened = fptree.search(t, item, ws, best)
        every = sorted((-s, d) for s, d in zip(scores(t, item, ws).tolist(), t.doc_ids.tolist()) if s > 0)[:300]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == every
        assert len(asked) < opened / 4 if limit > 1 else len(asked) > opened


def test_long_text_in_slices(spark):
    docs = spark.createDataFrame([(1, "Ab1 cd " * 30000 + "zz"), (2, "ab1")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in docs.mapInArrow(fptree._vectors(["ab1", "cd", "zz"], 64), "doc_id long, n long, terms array<int>, tfs array<bigint>").collect()}
    assert got[1]["n"] == 60001 and got[1]["terms"] == [0, 1, 2] and got[1]["tfs"] == [30000, 30000, 1] and got[2]["terms"] == [0]


def test_empty_and_clashing_names(spark, tables, empty):
    docs, items = tables
    assert fptree.ranked(empty, items).collect() == [] and fptree.ranked(docs, items.where("false")).collect() == []
    assert fptree.ranked(docs, items.where("item_id in (1007, 1008, 1010)")).collect() == []
    odd = spark.createDataFrame([(1, "q r", 2, 3, 4), (2, "s", 1, 1, 1)], "doc_id long, text string, `a.b` int, rank int, n int")
    got = made(fptree.ranked(odd, spark.createDataFrame([(5, "R", 1, 2)], "item_id long, text string, score int, `c``d` int")))
    assert [x[:3] for x in got] == [(5, 1, 1)]
