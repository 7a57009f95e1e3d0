import corpus_pipeline
from tests.conftest import SF

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, docs):
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "lang", "source", "n_chars")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == COLUMNS and after.count() > 0
        if name == "language ID":
            assert not {9000, 9003, 9008} & {r["doc_id"] for r in after.collect()}
            assert before.count() - after.count() <= 6
        if name == "MinHash near-dedup":
            assert [r["doc_id"] for r in after.collect()].count(9006) == 1
        before = after
    assert before.where("not lossless").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where("n_pieces > 0").count() > 100


def test_no_documents(spark, empty):
    before = empty
    for _, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, SF)
        assert before.collect() == []


def test_nulls_and_clashing_columns_at_each_stage(spark):
    rows = [(k, f"the cat number {k} and the dog sat on the mat while it was raining outside today {k * 7}", None, None, None, 1, 2, "x") for k in range(8)]
    rows += [(None, "le chat et le chien sont ici dans la maison avec nous", None, "src1", 3, 1, 2, "x")] * 2 + [(20, None, None, None, None, 1, 2, "x")]
    labelled = [(100 + k, "the dog and the cat are here with us in the house", "en", "src0", 4, 1, 2, "x") for k in range(6)]
    before = spark.createDataFrame(rows + labelled, "doc_id long, text string, lang string, source string, n_chars long, node int, k1 int, passes string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF).cache()
        assert after.count() > 0 and None not in {r["text"] for r in after.collect()}
        assert k == len(corpus_pipeline.STAGES) - 1 or after.columns == COLUMNS
        before = after


def test_passes_of_a_document_differ(spark):
    text = "international conversations about segmentation " * 40
    docs = spark.createDataFrame([(1, text, "en", "src0", len(text))] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.sentencepiece(spark, docs, SF)
    assert out.columns[: len(COLUMNS)] == COLUMNS and "nth" not in out.columns
    assert len({tuple(r["piece_ids"]) for r in out.collect()}) == 3
