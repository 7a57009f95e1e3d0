import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leadloom.llm import maxent
from leadloom.llm.textblocks import blocks
from tests.conftest import SF
from tests.llm.conftest import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    tokens = [words((r["text"] or "").translate(LOWER)) + ["\n"] for r in rows]
    count = Counter(x for r, t in zip(rows, tokens) if not held(r["doc_id"]) for x in t)
    n, v = sum(count.values()), len(count)
    want = Counter((r["doc_id"], held(r["doc_id"]), len(t), sum(count[x] > 0 for x in t), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), 5)) for r, t in zip(rows, tokens))
    out = maxent.scored(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out) == want
    return out


def test_base_and_model(docs):
    out = check(docs)
    own = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_words_beyond_the_held_ones(docs, monkeypatch):
    monkeypatch.setattr(maxent, "TOP", 1500)
    check(docs)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    count = np.sort(rng.integers(1, 500, 9000))[::-1]
    lexicon = maxent.Lexicon(rng.integers(1, 2**62, 9000).astype(np.uint64), count, int(count.sum()) + 700, 9500)
    w = maxent.Weights.new(lexicon)
    w.theta += rng.standard_normal(w.theta.shape).astype(np.float32)
    w.phi += rng.standard_normal(w.phi.shape).astype(np.float32)
    keys = rng.integers(0, 2**63, (1, maxent.FEATURES)).astype(np.uint64)
    x, whole = maxent.exponentials(w.theta, maxent.outer_rows(keys), w.by_class)
    by_class = (x / whole[:, None])[0].astype(float)
    cls, node, choice = lexicon.path(np.arange(9000))
    p = by_class[cls]
    for j in range(maxent.DEEPEST):
        own = np.flatnonzero(node[j] >= 0)
        x, whole = maxent.exponentials(w.phi, lexicon.inner_rows(np.repeat(keys, len(own), axis=0), node[j, own]), w.in_node, node[j, own])
        p[own] *= x[np.arange(len(own)), choice[j, own]] / whole
    assert set(node[0]) >= set(range(36)) and (node[2] >= 0).any()
    # The last class: the counted words beyond, and one unseen.
    assert p.sum() + by_class[-1] * (700 + 500 + 1) / lexicon.rest == pytest.approx(1, abs=1e-3)


def by_hand(texts, scored_texts):
    """Learning and scores by dictionaries and loops over tokens; hashes of features and the draws' numbers are the module's."""
    tokens = [words(t.translate(LOWER)) + ["\n"] for t in texts]
    count = Counter(x for t in tokens for x in t)
    n, v = sum(count.values()), len(count)

    def hashed(t):
        block = next(blocks(pa.array([t]), lower=True))
        return maxent.token_hashes(block)

    name = {x: int(h) for t in texts for x, h in zip(words(t.translate(LOWER)) + ["\n"], hashed(t)[0])}
    order = sorted(count, key=lambda x: (-count[x], name[x] - (2**64 if name[x] >= 2**63 else 0)))
    lexicon = maxent.Lexicon(np.array([name[x] for x in order], np.uint64), np.array([count[x] for x in order]), n, v)
    # The place of each rank in the tree, with the masses of all choices.
    path, mass, classes = {}, Counter(), Counter()
    first_rank = first_class = nodes = 0
    for number, depth in maxent.LEVELS:
        for r in range(first_rank, min(v, first_rank + number * 32**depth)):
            own, place = divmod(r - first_rank, 32**depth)
            steps, base = [], nodes
            for j in range(depth):
                steps.append((base + own * 32**j + place // 32 ** (depth - j), place // 32 ** (depth - j - 1) % 32))
                base += number * 32**j
            path[order[r]] = (first_class + own, steps)
        nodes += number * sum(32**j for j in range(depth))
        first_rank, first_class = first_rank + number * 32**depth, first_class + number
    for x in order:
        classes[path[x][0]] += count[x] + 1
        mass.update({s: count[x] + 1 for s in path[x][1]})
    classes[first_class] += 1
    theta, phi = defaultdict(float), defaultdict(float)

    def root(rows):
        e = [math.exp(max(-50.0, math.log(classes[c] / (n + v + 1))) + sum(theta[r, c] for r in rows)) if classes[c] else 0.0 for c in range(first_class + 1)]
        return [x / sum(e) for x in e]

    def below(node, rows):
        e = [mass[node, c] * math.exp(sum(phi[r, c] for r in rows)) for c in range(32)]
        return [x / sum(e) for x in e]

    def walk(t):
        h, k = hashed(t)
        keys = maxent.histories(h, k)
        for i, x in enumerate(words(t.translate(LOWER)) + ["\n"]):
            outer = maxent.outer_rows(keys[i : i + 1])[0].tolist()
            cls, steps = path.get(x, (first_class, []))
            yield i, x, cls, outer, [(s, c, lexicon.inner_rows(keys[i : i + 1], np.array([s]))[0].tolist()) for s, c in steps]

    def draw(p, u):
        total = 0.0
        for c, x in enumerate(p):
            total += x
            if total > u:
                return c
        return len(p) - 1

    for turn in range(maxent.ROUNDS):
        seen, drew, seen_in, drew_in = (defaultdict(float) for _ in range(4))
        for t in texts:
            u = maxent.randoms(*hashed(t), turn)
            for i, _, cls, outer, steps in walk(t):
                p = root(outer)
                got = draw(p, u[-1, i])
                for r in outer:
                    seen[r, cls] += 1
                    for c in range(first_class + 1):
                        drew[r, c] += p[c] if turn == 0 else c == got
                for j, (s, c, rows) in enumerate(steps):
                    p = below(s, rows)
                    got = draw(p, u[j, i])
                    for r in rows:
                        seen_in[r, c] += 1
                        for k in range(32):
                            drew_in[r, k] += p[k] if turn == 0 else k == got
        for kind, a, b, f in ((theta, seen, drew, 2.0), (phi, seen_in, drew_in, 1.5)):
            for r, c in set(a) | set(b):
                prior = 10.0 if turn else 300.0 * classes[c] / (n + v + 1) if kind is theta else 1.0
                if prior > 0:
                    kind[r, c] += max(-2.0, min(2.0, math.log((a[r, c] + prior) / (b[r, c] + prior)) / f))
    out = []
    for t in scored_texts:
        total = 0.0
        for _, x, cls, outer, steps in walk(t):
            p = root(outer)[cls] / (1 if x in path else classes[first_class])
            for s, c, rows in steps:
                p *= below(s, rows)[c]
            total += math.log10(p)
        out.append(total)
    return out


def test_scores_equal_those_by_hand(spark):
    rng = np.random.default_rng(2)
    known = [f"w{k}" for k in range(1100)]
    texts = [" ".join(known[min(1099, int(x))] for x in rng.exponential(60, 60)) for _ in range(60)] + ["A b a B", "x y  z\nA"]
    texts += [" ".join(known[k : k + 100]) for k in range(0, 1100, 100)]
    rows = [(k, t) for k, t in enumerate(texts)]
    learn = [t for k, t in rows if not held(k)]
    out = {r["doc_id"]: r["score"] for r in maxent.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = by_hand(learn, texts)
    errors = [abs(out[k] - want[k]) / len(words(t) + [1]) for k, t in rows]
    # A draw may differ where single and double precision do, so a few tokens in thousands may.
    assert sorted(errors)[len(errors) // 2] < 1e-3 and max(errors) < 0.02


def test_ties_at_the_last_held_rank_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(maxent, "TOP", 40)
    df = spark.createDataFrame([(k, f"a{k} b{k} c{k}", 1, 2) for k in range(40)], "doc_id long, text string, word int, held_out int")
    check(df)


def test_empty(empty):
    assert maxent.scored(empty).collect() == []


def test_scores_do_not_depend_on_the_partitions(spark):
    """Tallies are whole numbers, so their sums are the same however the texts are dealt; what is left is the rounding of a batch's products."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = ({r["doc_id"]: r["score"] for r in maxent.scored(docs.repartition(n, "doc_id")).collect()} for n in (1, 13))
    assert set(one) == set(many) and max(abs(one[k] - many[k]) / abs(one[k]) for k in one) < 1e-6


def test_packed_numbers():
    x = np.array([[0, 1, 255, 256], [1 << 31, (1 << 40) + 7, 3, 0]], np.int64)
    assert (maxent._unpacked(np.frombuffer(maxent._packed(x), np.uint8)) == x.ravel()).all()
