import hashlib

from pyspark.sql import functions as F

from leadloom.llm import chat, queries
from tests.conftest import SF, same

LOG = "conv_id long, seq long, kind string, msg long, role string, text string"


def test_equals_its_sql(spark, duck):
    same(queries.QUERIES["op4_chat_format"](spark, SF), duck.sql(queries.ORACLES["op4_chat_format"]))


def test_events_fold(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "he"), (1, 4, "delta", 2, None, "llo"),
        (1, 5, "edit", 1, None, "hey"), (1, 6, "message", 3, "user", "more"), (1, 7, "regenerate", 2, None, None), (1, 8, "delta", 2, None, "good day"),
        (1, 9, "message", 4, "user", "new"), (1, 10, "odd", 9, "user", "x"), (2, 1, "delta", 1, "assistant", None), (None, 1, None, 1, None, "n"),
    ]
    out = chat.reconstruct(spark.createDataFrame(log, LOG)).collect()
    got = sorted(((r["conv_id"] is None, r["conv_id"] or 0, r["msg"], r["role"], r["text"]) for r in out))
    assert got == [(False, 1, 1, "user", "hey"), (False, 1, 2, "assistant", "good day"), (False, 1, 4, "user", "new"), (False, 2, 1, "assistant", ""), (True, 0, 1, "", "n")]


def test_tied_events_go_by_kind_and_text(spark):
    log = [
        (1, 1, "message", 1, "user", "old"), (1, 2, "edit", 1, None, "new"), (1, 2, "delta", 1, None, "XX"), (1, 2, "delta", 1, None, "YY"),
        (2, 1, "message", 1, "user", "old"), (2, 2, "edit", 1, None, "a"), (2, 2, "edit", 1, None, "b"), (2, 3, "delta", 1, None, "!"), (2, 3, "delta", 1, None, "!"),
        (3, 1, "message", 1, "user", "x"), (3, 1, "message", 1, "user", "x"), (4, 1, "delta", 1, "user", "b"), (4, 1, "delta", 1, "assistant", "a"),
        (5, 1, "message", 1, "user", "q"), (5, 1, "regenerate", 1, None, "no"), (5, 2, "delta", 1, None, "yes"), (6, None, "delta", 1, None, "c"),
    ]
    out = {r["conv_id"]: (r["role"], r["text"]) for r in chat.reconstruct(spark.createDataFrame(log, LOG)).collect()}
    assert out == {1: ("user", "new"), 2: ("user", "b!!"), 3: ("user", "x"), 4: ("user", "ab"), 5: ("user", "yes"), 6: ("", "c")}


def test_rows_without_a_conversation_long_texts_and_clashing_columns(spark):
    rows = [(None, 1, "user", "a", 1, "k"), (None, 2, "user", "b", 2, "k"), (7, 1, "assistant", "</s>" * 50_000, 3, "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, lone int, kind string")
    out = sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.format_chats(df)).collect())
    assert out == [(0, 1, 0), (0, 1, 0), (7, 1, 200_000)]


def test_any_text_comes_back(spark):
    bad = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\/s>", "\\", "", None, "a\nb\n", "<<SYS>>", "é😀\x00", "$1 \\1 %0A"]
    rows = [(5, k, "assistant" if k % 2 else "us%0A<|im_end|>\ner", t) for k, t in enumerate(bad)] + [(5, 3, "assistant", "tie"), (6, None, None, None)]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("back", chat.parsed(F.col("formatted"))).collect()}
    order = sorted(((t, r or "", x or "") for _, t, r, x in rows if t is not None), key=lambda x: (x[0], x[1], x[2]))
    assert [tuple(x) for x in out[5]["back"]] == [(r, x) for _, r, x in order]
    assert out[6]["formatted"] == "<|im_start|>\n<|im_end|>\n" and out[6]["loss_spans"] == []
    assert out[5]["formatted"].count("<|im_start|>") == len(order)


def test_digests(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "</s>é")], "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.format_chats(rows)).first()
    assert r["turns_sha256"] == hashlib.sha256("user\nq\nassistant\n</s>é\n".encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, 5, hashlib.sha256("</s>é".encode()).hexdigest())
    assert chat.digests(chat.format_chats(rows.where("false"))).collect() == []


def test_no_python_in_the_plan(spark):
    plan = queries.QUERIES["op4_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
