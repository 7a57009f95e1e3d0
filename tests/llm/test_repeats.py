import hashlib
from collections import Counter

from leadloom.llm.repeats import substring_dedup
from tests.llm.conftest import words


def brute(rows, window=35):
    texts = [words(r["text"]) for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = Counter()
    for r, w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[r["doc_id"], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return out


def test_equals_brute_force(docs):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in substring_dedup(docs).collect())
    assert got == brute(docs.collect())


def test_shared_passage_and_spans(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(k, f"own{k} {passage} tail{k}") for k in range(5)] + [(9, " ".join(f"x{i}" for i in range(80)))]
    out = {r["doc_id"]: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["kept_text"] == "own0 tail0" and [tuple(s) for s in out[0]["removed_spans"]] == [(1, 61)]
    assert out[9]["n_removed"] == 0


def test_empty(empty):
    assert substring_dedup(empty).collect() == []
