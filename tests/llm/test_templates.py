import re
import time
from collections import Counter, defaultdict

from leadloom.llm.templates import dedup_lines
from tests.llm.conftest import words


def brute(rows, min_docs, share=0.7, depth=3):
    def name(r):
        return (2**63 - 1 if r[0] is None else r[0], r[1] or "")

    lines, leaf, held, docs = [], defaultdict(set), Counter(), defaultdict(set)
    for d in {name(r) for r in rows}:
        for i, line in enumerate(d[1].split("\n")):
            t = tuple("<*>" if re.search("[0-9]", x) else x for x in words(line))
            if t:
                lines.append((d, i, t))
                leaf[len(t), t[:depth]].add(d)
    lines = [x for x in lines if len(leaf[len(x[2]), x[2][:depth]]) >= min_docs]
    for d, _, t in lines:
        docs[t].add(d)
    for t, ds in docs.items():
        held.update({(len(t), t[:depth], p, x): len(ds) for p, x in enumerate(t)})
    made, spread, drop = {}, defaultdict(set), defaultdict(set)
    for t in docs:
        f = tuple(x if held[len(t), t[:depth], p, x] >= min_docs else None for p, x in enumerate(t))
        if sum(x is not None for x in f) >= share * len(t) and any(x not in (None, "<*>") for x in f):
            made[t] = f
    for d, _, t in lines:
        if t in made:
            spread[made[t]].add(d)
    for d, i, t in lines:
        if t in made and len(spread[made[t]]) >= min_docs and d[0] != min(spread[made[t]])[0]:
            drop[d].add(i)
    out = Counter()
    for r in rows:
        gone = drop[name(r)]
        text = None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone)
        out[r[0], text, 0 if r[1] is None else len(r[1].split("\n")), len(gone)] += 1
    return out


def test_equals_brute_force(docs, spark):
    posts = [(5000 + i, f"Posted on 2024-01-{i:02d} by user {i * 7} in the forum\nunique line number one two {chr(97 + i)} three\nown {i} x{i}") for i in range(12)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(posts + [(None, posts[0][1]), (5003, posts[3][1])], "doc_id long, text string"))
    out = dedup_lines(rows, min_docs=6).collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out) == brute([tuple(r) for r in rows.collect()], 6)
    assert sum(r["n_dropped"] for r in out) > 20


def test_short_lines_go_but_bare_numbers_stay(spark):
    rows = [(k, f"Home\n{k}\nPage {k}\n12 {k}\nown{chr(97 + k)} word{chr(97 + k)}\n\n  ") for k in range(12)]
    out = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["n_dropped"] == 0
    for k in range(1, 12):
        assert out[k]["text"] == f"{k}\n12 {k}\nown{chr(97 + k)} word{chr(97 + k)}\n\n  " and out[k]["n_dropped"] == 2


def test_a_very_long_text_of_dropped_lines(spark):
    rows = [(k, "read more of this\nkept") for k in range(11)] + [(99, "read more of this\n" * 200_000 + "end of it")]
    began = time.time()
    out = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[99]["text"] == "end of it" and out[99]["n_dropped"] == 200_000
    assert time.time() - began < 120


def test_other_columns_and_empty(empty, spark):
    assert dedup_lines(empty).columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert dedup_lines(empty).collect() == []
    clash = spark.createDataFrame([(1, "a b c", 7, "x", 3)], "doc_id long, text string, n_lines int, k1 string, line int")
    assert dedup_lines(clash).first().asDict() == {"doc_id": 1, "text": "a b c", "k1": "x", "line": 3, "n_lines": 1, "n_dropped": 0}
