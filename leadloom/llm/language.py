"""Language identification (operator 8).

Sparse multinomial logistic regression on TF-IDF of hashed character n-grams, fitted by
follow-the-regularised-leader with an elastic-net penalty and calibrated by a temperature.  Document
frequencies cover all documents that may be learned from; the weights are fitted on at most
``SAMPLE`` of them for each language and about ``FITTED`` in all, those of the smallest hashes.  Whole
texts are read in learning and scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import named, nameless, small_batches
from .textblocks import blocks, lists

BITS, SIZES = 17, 3
#: Upper bounds of the fitted documents: of one language, and of all, but for one of each language.
SAMPLE, FITTED = 500, 20_000
UNKNOWN = "und"
_SCALE = 30.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: itself if it is a letter, else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    own = [c for c in range(0x110000) if chr(c).isalpha()]
    table[own] = own
    return table


def features(block) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(hashed n-grams for n = 1, 2, 3 from each place; limits of the texts in them; texts that have a letter).

    Characters that are no letters are one separator; two stand before each text.
    """
    raw = block.data.tobytes()
    texts = [raw[a:b].decode() for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist())]
    codes = np.frombuffer("".join("  " + t for t in texts).encode("utf-32-le") + bytes(8), dtype=np.uint32)
    letters = _letters()[codes]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])]).astype(np.int64)
    n, shift = int(bounds[-1]), np.uint32(32 - BITS)
    sums = np.concatenate([[0], np.cumsum(letters[:n] > 0)])
    some = sums[bounds[1:]] > sums[bounds[:-1]]
    mult, out = np.uint32(0x9E3779B1), []
    run = np.zeros(n, dtype=np.uint32)
    for k in range(SIZES):
        run = run * np.uint32(0x01000193) + letters[k : k + n] + np.uint32(k + 1)
        x = run * mult
        x ^= x >> np.uint32(15)
        out.append((x * np.uint32(0x85EBCA6B)) >> shift)
    return out, bounds, some


def _lowered(batch: pa.RecordBatch) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(batch.column("text"), ""))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << BITS) + 1, dtype=np.int64)
    for batch in batches:
        for block in blocks(_lowered(batch)):
            grams, bounds, some = features(block)
            for i in range(block.rows):
                if some[i]:
                    seen = np.zeros(1 << BITS, dtype=bool)
                    for g in grams:
                        seen[g[bounds[i] : bounds[i + 1]]] = True
                    total[:-1] += seen
                    total[-1] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["feature", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(_lowered(batch)):
            grams, bounds, some = features(block)
            row, index, share, counts = [], [], [], []
            for i in np.flatnonzero(some):
                own, n = np.unique(np.concatenate([g[bounds[i] : bounds[i + 1]] for g in grams]), return_counts=True)
                row.append(block.first + i)
                index.append(own.astype(np.int32))
                share.append((n / n.sum()).astype(np.float32))
                counts.append(len(own))
            if row:
                part = batch.select(["lang", "pick"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("pick"), lists(np.concatenate(index), counts), lists(np.concatenate(share), counts)],
                    names=["lang", "pick", "index", "share"],
                )


@dataclass
class Model:
    """``table``: for each feature and language the weight times the inverse document frequency."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
    """FTRL-proximal: (weights by feature and class, biases).  ``rows``: indices, shares, class."""
    z, n = np.zeros((len(idf) + 1, classes)), np.zeros((len(idf) + 1, classes))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            at, share, y = rows[r]
            at, x = np.append(at, len(idf)), np.append(share * idf[at] * _SCALE, 1.0)
            w = weights(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(len(idf) + 1))
    return w[:-1], w[-1]


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the smallest negative log likelihood, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]).mean())

    low, high, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def chosen(docs: DataFrame, sizes: dict[str, int], sample: int = SAMPLE) -> DataFrame:
    """(lang, pick, text): for each language the ``sample`` rows of the smallest hashes, fewer where there are many languages.

    ``sizes``: rows by language.  Hashes below twice the share that the sample has are looked at, so that
    few rows meet; a language that has too few of them, as where all rows are equal, is looked at whole.
    Rows with equal hashes at a limit are cut by number.
    """
    each = max(1, min(sample, FITTED // max(1, len(sizes))))
    keyed = docs.withColumn("pick", F.xxhash64(F.lit(11), "doc_id", "text"))
    most = 2**63 - 1

    def below(limits: dict[str, int]) -> DataFrame:
        # An entry for each language in the expression, so that no text moves.
        return keyed.where(F.col("pick") <= F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("lang")])

    limits = {lang: most if n <= 2 * each else -(2**63) + 2 * each * 2**64 // n for lang, n in sizes.items()}
    found = {r["lang"]: r["n"] for r in below(limits).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    limits = {lang: k if found.get(lang, 0) >= min(each, sizes[lang]) else most for lang, k in limits.items()}
    first = Window.partitionBy("lang").orderBy("pick")
    return below(limits).withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).select("lang", "pick", "text")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of ``docs`` (doc_id, text, lang), which hold only what may be learned from; None if they name no language."""
    docs = docs.where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    counts = docs.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((1 << BITS) + 1)
    df[counts["feature"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    idf = np.log((1 + df[-1]) / (1 + df[:-1]))
    taken = chosen(docs, sizes, sample).mapInArrow(_vectors, "lang string, pick long, index array<int>, share array<float>").toArrow()
    rows = []
    for batch in taken.to_batches():
        for field in ("index", "share"):
            assert batch.column(field).null_count == 0
        index, value = batch.column("index"), batch.column("share")
        for k in range(batch.num_rows):
            rows.append((batch.column("pick")[k].as_py(), index[k].values.to_numpy(), value[k].values.to_numpy(), languages.index(batch.column("lang")[k].as_py())))
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], r[3], len(r[1])))
    order = np.random.default_rng(3).permutation(len(rows))
    held = {int(k) for k in order[: len(rows) // 5]}
    train = [rows[k][1:] for k in range(len(rows)) if k not in held]
    w, bias = follow_leader(train, idf, len(languages))
    table = (w * idf[:, None] * _SCALE).astype(np.float32)
    logits = np.array([rows[k][2] @ table[rows[k][1]] + bias for k in sorted(held)]).reshape(-1, len(languages))
    return Model(languages, table, bias, calibrated(logits, np.array([rows[k][3] for k in sorted(held)], dtype=np.int64)))


def _predict(model: Model | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(_lowered(batch)):
                grams, bounds, some = features(block)
                if model is None:
                    some[:] = False
                    best, score = np.zeros(block.rows, np.int64), np.zeros(block.rows)
                else:
                    sums = sum(np.add.reduceat(model.table[g], bounds[:-1], axis=0, dtype=np.float64) for g in grams)
                    p = model.probabilities(sums / (SIZES * np.diff(bounds))[:, None] + model.bias)
                    best, score = p.argmax(axis=1), np.where(some, p.max(axis=1), 0.0)
                known = np.array([*(model.languages if model else []), UNKNOWN], dtype=object)
                lang = known[np.where(some, best, len(known) - 1)]
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` and lang_pred, score (the calibrated probability).

    Only ``text`` is an input.  A null text, or one without a letter, is ``und`` with score 0, and so is
    every text under no model.  Columns named lang_pred or score are replaced, others stay whatever their names are.
    """
    small_batches(docs.sparkSession)
    plain, names = nameless(docs, ("lang_pred", "score"))
    fields = ", ".join(f"{c} {t}" for c, t in plain.dtypes)
    # The text stands behind the columns that are returned.
    rows = plain.withColumn("text", F.col(f"c{names.index('text')}"))
    return named(rows.mapInArrow(_predict(model, plain.columns), f"{fields}, lang_pred string, score double"), [*names, "lang_pred", "score"])


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; rows with fold(3) = 1 teach nothing."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (fold("doc_id", 3) == 1).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")).drop("held_out"))
    return identify(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
