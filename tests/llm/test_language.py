import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from leadloom.llm import language


def test_held_out_accuracy(docs):
    rows = {(r["doc_id"], r["text"]): r for r in docs.where("doc_id < 9000").collect()}
    out = language.held_out_languages(docs).collect()
    assert len(out) == docs.count()
    tested = right = 0
    for r in out:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000:
            tested += 1
            right += next(x["lang"] for k, x in rows.items() if k[0] == r["doc_id"]) == r["lang_pred"]
    assert tested > 40 and right / tested >= 0.97


def test_no_letters_is_und(docs):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.held_out_languages(docs).collect()}
    assert got[9000] == got[9003] == got[9008] == ("und", 0.0)
    assert got[9005][0] != "und"


def test_text_alone_decides(docs, spark):
    model = language.fit(docs)
    same = spark.createDataFrame([(1, "le chat et la souris", "en", "a"), (2, "le chat et la souris", "de", "b")], "doc_id long, text string, lang string, score string")
    a, b = language.identify(same, model).collect()
    assert (a["lang_pred"], a["score"]) == (b["lang_pred"], b["score"])


def test_the_sample_is_bounded_and_repeated_rows_are_cut(spark, monkeypatch):
    rows = [(1, "same text", "en")] * 3000 + [(k, f"texte {k}", "fr") for k in range(1800)] + [(k, "wort", "de") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    count = lambda out: {r["lang"]: r["count"] for r in out.groupBy("lang").count().collect()}
    assert count(language.chosen(df, {"en": 3000, "fr": 1800, "de": 3})) == {"en": language.SAMPLE, "fr": language.SAMPLE, "de": 3}
    monkeypatch.setattr(language, "FITTED", 30)
    assert count(language.chosen(df, {"en": 3000, "fr": 1800, "de": 3})) == {"en": 10, "fr": 10, "de": 3}


def by_hand(rows, texts):
    """The same model by dictionaries and loops: (languages, probabilities of each text)."""
    m32 = 2**32 - 1

    def grams(text):
        codes = [ord(c) if c.isalpha() else 0 for c in "  " + text.lower()] + [0, 0]
        found = Counter()
        for i in range(len(codes) - 2):
            run = 0
            for k in range(3):
                run = (run * 0x01000193 + codes[i + k] + k + 1) & m32
                x = run * 0x9E3779B1 & m32
                x ^= x >> 15
                found[(x * 0x85EBCA6B & m32) >> (32 - language.BITS)] += 1
        return found

    langs = sorted({r[1] for r in rows})
    vectors = [(grams(t), langs.index(lang), pick) for t, lang, pick in rows]
    df = Counter(g for v, _, _ in vectors for g in v)
    idf = lambda g: math.log((1 + len(rows)) / (1 + df[g]))
    vectors.sort(key=lambda v: (v[2], v[1], len(v[0])))
    order = np.random.default_rng(3).permutation(len(vectors))
    held = sorted(order[: len(vectors) // 5].tolist())
    train = [vectors[k] for k in range(len(vectors)) if k not in held]
    z, n = defaultdict(float), defaultdict(float)

    def weight(g, c):
        return 0.0 if abs(z[g, c]) <= 1e-3 else -(z[g, c] - math.copysign(1e-3, z[g, c])) / ((1.0 + math.sqrt(n[g, c])) / 0.5 + 1e-3)

    def logits(v):
        total = sum(v.values())
        return [sum(30.0 * idf(g) * k / total * weight(g, c) for g, k in v.items()) + weight("bias", c) for c in range(len(langs))]

    def softmax(x, t=1.0):
        e = [math.exp((a - max(x)) / t) for a in x]
        return [a / sum(e) for a in e]

    for epoch in range(4):
        for r in np.random.default_rng(epoch).permutation(len(train)):
            v, y, _ = train[r]
            p = softmax(logits(v))
            values = {g: 30.0 * idf(g) * k / sum(v.values()) for g, k in v.items()} | {"bias": 1.0}
            now = {(g, c): weight(g, c) for g in values for c in range(len(langs))}
            for g, x in values.items():
                for c in range(len(langs)):
                    d = x * (p[c] - (c == y))
                    z[g, c] += d - (math.sqrt(n[g, c] + d * d) - math.sqrt(n[g, c])) / 0.5 * now[g, c]
                    n[g, c] += d * d
    known = [(logits(vectors[k][0]), vectors[k][1]) for k in held]
    loss = lambda t: -sum(math.log(softmax(x, t)[y]) for x, y in known)
    best = min((math.exp(math.log(0.05) + k * math.log(400) / 4000) for k in range(4001)), key=loss)
    return langs, best, [softmax(logits(grams(t)), best) for t in texts]


def test_equals_ftrl_and_tf_idf_by_hand(spark):
    rng = np.random.default_rng(5)
    words = {"aa": ["the", "cat", "and", "then", "Ünd"], "bb": ["le", "chat", "et", "puis", "the"], "cc": ["die", "katze", "und", "dann"]}
    # A third of the labels is wrong, so that the best temperature is inside its range.
    rows = [(k, " ".join(rng.choice(words[lang if k % 3 else "aa"], 6)), lang) for k, lang in enumerate(["aa", "bb", "cc", "bb"] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picks = {r["doc_id"]: r["pick"] for r in df.selectExpr("doc_id", "xxhash64(11, doc_id, text) AS pick").collect()}
    texts = ["the cat und le chat", "katze", "x 1", "puis the cat then"]
    langs, temperature, want = by_hand([(t, lang, picks[k]) for k, t, lang in rows], texts)
    model = language.fit(df)
    assert model.languages == langs and abs(math.log(model.temperature / temperature)) < 0.02
    tested = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in language.identify(tested, model).collect():
        p = want[r["doc_id"]]
        assert r["lang_pred"] == langs[int(np.argmax(p))] and abs(r["score"] - max(p)) < 0.01


def test_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([(k, "same words", lang) for k, lang in enumerate(["bb", "aa"] * 10)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(df, language.fit(df)).collect()} <= {"aa", "bb"}


def test_nothing_to_learn(empty, docs):
    assert language.held_out_languages(empty).collect() == []
    unlabelled = docs.selectExpr("doc_id", "text", "string(null) lang")
    assert {r["lang_pred"] for r in language.held_out_languages(unlabelled).collect()} == {"und"}
