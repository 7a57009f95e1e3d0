import hashlib
import re

import numpy as np
import pyarrow as pa
import sentencepiece

from leadloom.llm import pieces
from leadloom.llm.textblocks import blocks


def test_round_trip(docs):
    encoded = pieces.encode(docs).cache()
    texts = sorted(((r["doc_id"] or -1, r["text"]) for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"] or -1, r["text"]) for r in pieces.decode(encoded).collect()), key=str) == texts
    for r in encoded.collect():
        if r["text"] is None:
            assert r["piece_ids"] is None and r["n_pieces"] is None
        else:
            assert r["lossless"] and r["n_pieces"] == len(r["piece_ids"]) and r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_without_dropout_it_is_the_library(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in pieces.encode(docs, dropout=0.0).where("text is not null").collect():
        if "▁" not in r["text"]:
            assert r["piece_ids"] == library.encode(r["text"])


def test_dropout_varies_by_seed_and_place_but_not_by_run(spark):
    df = spark.createDataFrame([(1, "international conversations " * 40)], "doc_id long, text string")
    ids = [pieces.encode(df, dropout=0.3, seed=s).first()["piece_ids"] for s in (1, 1, 2)]
    assert ids[0] == ids[1] != ids[2]
    vocab = pieces.read_model(pieces.MODEL)
    assert len({tuple(ids[0][k : k + 6]) for k in range(len(ids[0]))}) > 6 and vocab.spelled[ids[0][0]].startswith(b" ")


def test_each_occurrence_has_its_own_dropout(spark):
    df = spark.createDataFrame([(1, "international " * 400)], "doc_id long, text string")
    ids = pieces.encode(df, dropout=0.3).first()["piece_ids"]
    vocab = pieces.read_model(pieces.MODEL)
    found, word = set(), []
    for i in ids:
        if vocab.spelled[i].startswith(b" ") and word:
            found.add(tuple(word))
            word = []
        word.append(i)
    assert len(found) > 20


def test_sharing_equals_merging_each_occurrence(monkeypatch):
    vocab = pieces.read_model(pieces.MODEL)
    rng = np.random.default_rng(1)
    known = ["".join(rng.choice(list("etaoinshr"), n)) for n in (1, 2, 3, 5, 8, 8, 13, 30, 60)] + ["international", "the", "çé▁"]
    block = next(blocks(pa.array([" ".join(rng.choice(known, 200)) for _ in range(5)] + [""])))
    names = np.arange(6, dtype=np.uint64)
    ids, counts = pieces.encode_block(vocab, block, names, 0.1, 3)
    monkeypatch.setattr(pieces, "_skipping", lambda seen, back, key, dropout: np.arange(len(back)))
    all_ids, all_counts = pieces.encode_block(vocab, block, names, 0.1, 3)
    assert np.array_equal(ids, all_ids) and np.array_equal(counts, all_counts)


def test_rows_equal_agenda():
    vocab = pieces.read_model(pieces.MODEL)
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("etaoinshr é"), rng.integers(1, 14))) for _ in range(300)]
    symbols = [vocab.symbols(np.array([ord(c) for c in w])) for w in words]
    rows = np.full((300, 14), pieces.PAD, np.int32)
    for k, s in enumerate(symbols):
        rows[k, : len(s)] = s
    key = np.arange(300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = pieces.merge_rows(vocab, rows, np.array([len(s) for s in symbols]), key, 0.3)
    for k, s in enumerate(symbols):
        assert [x for x in out[k].tolist() if x != pieces.PAD] == pieces.merge_one(vocab, s.tolist(), int(key[k]), 0.3)


def test_input_columns_named_like_the_key(spark):
    df = spark.createDataFrame([(1, "some words here", 5, "x")], "doc_id long, text string, _key int, ids string")
    r = pieces.encode(df).first()
    assert r["_key"] == 5 and r["ids"] == "x" and r["lossless"]
    assert r["piece_ids"] == pieces.encode(df.select("doc_id", "text")).first()["piece_ids"]


def by_hand(vocab, library, text, name, dropout, seed):
    """Pieces of a text by the definition alone: every chunk's best kept candidate is merged until none is left."""

    def scramble(x):
        x &= 2**64 - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    known = {library.id_to_piece(i): i for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    base = 0x9E3779B97F4A7C15 | 1
    out = []
    for nth, chunk in enumerate(re.findall(r" +[^ ]*|[^ ]+", " " + text)):
        h, power = 0, 1
        for c in chunk:
            h, power = (h + scramble(ord(c) + 1) * power) % 2**64, power * base % 2**64
        key = scramble(scramble(h + len(chunk)) + scramble(scramble(name + scramble(seed)) + nth))
        parts = [(k, k + 1, c.replace(" ", "▁") if c != "▁" else None) for k, c in enumerate(chunk)]
        while True:
            best = None
            for k, ((a, m, x), (_, e, y)) in enumerate(zip(parts, parts[1:])):
                new = None if x is None or y is None or x not in known or y not in known else known.get(x + y)
                if new is not None:
                    at = a * 0x100000001B3 + m * 0xC2B2AE3D27D4EB4F + e * 0x165667B19E3779F9
                    if (scramble(key + at) >> 11) * 2.0**-53 >= dropout and (best is None or (-library.get_score(new), k) < best):
                        best = (-library.get_score(new), k)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [(parts[k][0], parts[k + 1][1], parts[k][2] + parts[k + 1][2])]
        for a, e, x in parts:
            out += [known[x]] if x in known else [library.piece_to_id(f"<0x{b:02X}>") for b in chunk[a:e].encode()]
    return out


def test_dropout_equals_the_definition_step_by_step(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    vocab = pieces.read_model(pieces.MODEL)
    texts = ["international conversations  on the 日本 é▁x", " leading", "a" * 50 + " the theatre", "banana bandana " * 6]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "xxhash64(doc_id) AS name")
    for dropout in (0.0, 0.3):
        for r in pieces.encode(df, dropout=dropout).collect():
            assert r["piece_ids"] == by_hand(vocab, library, r["text"], r["name"] % 2**64, dropout, pieces.SEED), (dropout, r["text"])


def test_long_words_and_clashing_columns(spark, empty):
    long = "ab" * 4000
    df = spark.createDataFrame([(1, long, 5)], "doc_id long, text string, n_pieces int")
    r = pieces.encode(df).first()
    assert r["lossless"] and r["n_pieces"] == len(r["piece_ids"])
    assert pieces.encode(empty).collect() == []
    assert [b.rows for b in blocks(pa.array(["a", None, "b" * 100]), limit=50)] == [2, 1]
