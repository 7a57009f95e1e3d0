"""Columns of any name beside those that an operator reads, in every operator and every stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import bagminhash, bytebpe, chat, chatrepair, fptree, language, maxent, mixing, nndescent, pieces, repeats, templates, topk

ODD = ("a.b", "c`d", 'e"f', " g h ", "row", "doc", "line", "c0", "k1", "key", "r", "parts", "nth", "node", "é.`x`")


@pytest.fixture(scope="module")
def odd(docs):
    """Some documents with columns whose names clash or hold what names seldom hold."""
    some = docs.where("doc_id < 12 or doc_id >= 9000")
    return some.select("*", *(F.lit(k).alias(n) for k, n in enumerate(ODD)))


KEEP = {
    "line dedup": (templates.dedup_lines, ("n_lines", "n_dropped")),
    "language": (lambda d: language.identify(d, language.fit(d.where("doc_id < 9000"))), ("lang_pred", "score")),
    "pieces": (pieces.encode, pieces.ADDED),
    "byte bpe": (bytebpe.encode, bytebpe.ADDED),
    "mixing": (lambda d: mixing.texts(d, per_mille=1000, epochs=2), ()),
}


@pytest.mark.parametrize("name", KEEP)
def test_rows_keep_their_columns(odd, name):
    made, added = KEEP[name]
    out = made(odd)
    assert out.columns == [*odd.columns, *added]
    rows = out.collect()
    assert rows and all(tuple(r[len(odd.columns) - len(ODD) : len(odd.columns)]) == tuple(range(len(ODD))) for r in rows)


def vectors(spark):
    rows = spark.range(20).select(F.col("id").alias("vec_id"), F.lit("a").alias("label"), F.array(*(F.sin(F.col("id") * k).cast("float") for k in range(1, 5))).alias("embedding"))
    return rows.select("*", *(F.lit(k).alias(n) for k, n in enumerate(ODD)))


def turns(spark):
    rows = spark.range(12).selectExpr("id div 4 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id, '.') AS text")
    return rows.select("*", *(F.lit(k).alias(n) for k, n in enumerate(ODD)))


def test_others_ignore_them(spark, odd):
    for f in (bagminhash.near_duplicates, repeats.substring_dedup, maxent.scored, mixing.mix):
        assert f(odd).count() >= 0
    assert fptree.ranked(odd, odd.select(F.col("doc_id").alias("item_id"), "text", *(F.col("`" + n.replace("`", "``") + "`") for n in ODD)).limit(3)).count() > 0
    for f in (topk.top_inner_products, nndescent.near_vectors):
        assert f(vectors(spark)).count() > 0
    assert chat.digests(chat.format_chats(turns(spark).select("conv_id", "turn", "role", "text"))).count() == 3 == chatrepair.repair(turns(spark)).count()


def test_stages_take_them(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, "").count() >= 0
