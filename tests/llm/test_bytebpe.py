import hashlib

import public_tokenizers
import pytest
import tiktoken

from leadloom.llm import bytebpe, queries
from tests.conftest import SF

TEXTS = [
    "", " ", "\n\n  x", "it's 12  3\t4", "▁ 日本語 😀 é\x00", "a  b  c　 d\u0085 e", "\x1c \x1c", "<|endoftext|>", "x" * 3000, "日本" * 500, "\U0001f468‍\U0001f469 é é ",
    "  lead and trail  ", "'LL we'll\r\n\r\n \r\n end", "  ᠎ ﻿ z",
]


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(bytebpe.RANKS), special_tokens={})


def test_equals_the_rank_library(docs, own):
    rows = docs.unionByName(docs.sparkSession.createDataFrame([(20000 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string"), allowMissingColumns=True)
    encoded = bytebpe.encode(rows.select("doc_id", "text").withColumn("copy", rows["text"]))
    out = bytebpe.decode(encoded.drop("text")).collect()
    assert len(out) == rows.count()
    for r in out:
        text = r["copy"] or ""
        assert r["token_ids"] == own.encode_ordinary(text) and r["n_tokens"] == len(r["token_ids"])
        assert r["text"] == text and bytes(r["decoded"]) == text.encode()


def test_offsets_and_split_characters(spark, own):
    tokenizer = bytebpe.tokenizer(bytebpe.specification())
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k long, text string")
    out = {r["k"]: r for r in bytebpe.decode(bytebpe.encode(rows), pieces=True).collect()}
    for k, text in enumerate(TEXTS):
        whole = tokenizer.encode(text, add_special_tokens=False)
        assert list(zip(out[k]["starts"], out[k]["ends"])) == whole.offsets
        assert "".join(out[k]["texts"]) == text
        held = [b"".join(own.decode_single_token_bytes(i) for i in out[k]["token_ids"][: j + 1]).decode(errors="ignore") for j in range(len(out[k]["texts"]))]
        assert ["".join(out[k]["texts"][: j + 1]) for j in range(len(held))] == held
    assert any("" in r["texts"] for r in out.values())


def test_ids_that_make_no_characters(spark):
    ranks = bytebpe.read_ranks(bytebpe.RANKS)
    rows = spark.createDataFrame([(0, [ranks[b"\xe3"]]), (1, [ranks[b"\xe3"], ranks[b"a"]]), (2, None), (3, [])], "k long, token_ids array<int>")
    out = {r["k"]: r for r in bytebpe.decode(rows, pieces=True).collect()}
    assert bytes(out[0]["decoded"]) == b"\xe3" and out[0]["text"] == "�" and out[1]["text"] == "�a"
    assert out[2]["text"] is None and out[2]["decoded"] is None and out[3]["text"] == "" and out[3]["texts"] == []
    with pytest.raises(Exception, match="outside the table"):
        bytebpe.decode(spark.createDataFrame([([60000],)], "token_ids array<int>")).collect()


def test_slices_cut_nothing(own):
    """Short slices, within texts too, give the ids of whole texts; so does a forgetful memory of chunks."""
    import numpy as np

    data = [t.encode() for t in TEXTS]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    joined, chunks, real = np.frombuffer(b"".join(data), np.uint8), bytebpe.Chunks(bytebpe.specification()), bytebpe.slices
    want = [bytebpe.encode_block(joined, bounds, chunks)]
    for limit in (1, 7, 100):
        bytebpe.slices = lambda d, b: real(d, b, limit)
        chunks.clear()
        want.append(bytebpe.encode_block(joined, bounds, chunks))
    bytebpe.slices = real
    for other in want[1:]:
        assert all((a == b).all() for a, b in zip(want[0], other))
    assert want[0][0].tolist() == [i for t in TEXTS for i in own.encode_ordinary(t)]


def test_many_chunks_are_few_texts_of_the_library(own):
    """Chunks that may follow each other are encoded as one text; those that may not, at odd limits, stay apart."""
    import numpy as np

    data = [t.encode() for t in TEXTS + [" ".join(f"w{k} é日{k}\u3000" for k in range(5000))]]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    chunks, calls = bytebpe.Chunks(bytebpe.specification()), []
    library = chunks.encode_batch
    chunks.encode_batch = lambda texts, **k: calls.append(len(texts)) or library(texts, **k)
    ids = bytebpe.encode_block(np.frombuffer(b"".join(data), np.uint8), bounds, chunks)[0]
    assert ids.tolist() == [i for d in data for i in own.encode_ordinary(d.decode())]
    assert len(chunks.first) > 5000 and sum(calls) < 100


def test_tokens_that_share_a_character(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, None])], "k long, text string")
    found = bytebpe.encode(rows.coalesce(1)).collect()
    assert [r["n_shared"] for r in found] == [sum(a < b for a, b in zip(r["starts"][1:], r["ends"])) for r in found] and any(r["n_shared"] for r in found)


def test_ranks_without_a_byte_are_refused(tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="lack a byte"):
        bytebpe.specification(str(tmp_path / "few"))


def test_names_nulls_and_empty(spark, empty):
    rows = spark.createDataFrame([(None, "a b", 1, 2, 3), (1, None, 1, None, 3), (1, None, 1, None, 3)], "doc_id long, text string, `a.b` int, `c``d` int, token_ids int")
    out = bytebpe.encode(rows)
    assert out.columns == ["doc_id", "text", "a.b", "c`d", *bytebpe.ADDED]
    assert sorted(r["n_tokens"] for r in out.collect()) == [0, 0, 2]
    assert bytebpe.decode(bytebpe.encode(empty)).collect() == []


def test_query(spark, own):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op12_byte_bpe_codec"](spark, SF).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = own.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()
