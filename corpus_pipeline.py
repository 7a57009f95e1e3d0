"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.llm import bagminhash, language, mixing, pieces, templates
from leadloom.llm.store import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is known with less than this calibrated probability go, as do those without a letter.
LEAST_SCORE = 0.5
#: The mix may spend as many tokens as there are, and read a document three times.
PER_MILLE, EPOCHS = 1000, 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, under the predicted one."""
    learn = docs.where(language.fold("doc_id", 3) != 1)
    found = language.identify(docs, language.fit(learn.select("doc_id", "text", "lang")))
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; documents that have nothing else go."""
    out = templates.dedup_lines(docs)
    some = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(some).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one of the smallest id, a copy of that id once."""
    classes = bagminhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(classes, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, the last of a leaf cut to its token-prefix."""
    return mixing.texts(docs, per_mille=PER_MILLE, epochs=EPOCHS).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces; of equal rows, the passes of a mix, each has a dropout of its own."""
    nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
    numbered = docs.select(*COLUMNS, nth.alias("nth"))
    return pieces.encode(numbered, key=("doc_id", "nth")).drop("nth")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("SentencePiece", sentencepiece),
]
#: SQL can't express the trained and hashed stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
