"""Substring dedup by seed and extend (operator 10).

Every run of ``window`` words holds at least one winnowed anchor: the smallest hash among its
``gram``-word runs, the leftmost of equal ones.  Equal windows choose the same anchor at the same
offset, so texts are joined on anchors alone.  An anchor that stands at two places is extended to
both sides: all windows that chose it, i.e. every length of left context with the right context that
fills up the window.  Equal extensions are pre-aggregated as a whole; only the windows of extensions
that stand once are compared one by one.  The union of repeated windows is the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_batches, stored
from .textblocks import blocks, lists, runs, span_hashes, words

WINDOW, GRAM = 35, 8


def chosen(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the smallest, the leftmost of equal ones."""
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    place, span = np.arange(len(hashes)), 1

    def smaller(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(hashes[left] <= hashes[right], left, right)

    while 2 * span <= width:
        place = smaller(place[: len(place) - span], place[span:])
        span *= 2
    return smaller(place[:m], place[width - span : width - span + m])


def _keyed() -> list[Column]:
    """Two 64-bit hashes of each text name it, so copies and repeated rows need no row of their own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("text")]


def _per_text(block, window: int, gram: int):
    """(row, word hashes, window hashes, chosen anchors, gram hashes) of each text with a window."""
    w = words(block)
    h = span_hashes(block.data, w.start, w.end)
    grams, wins, first = runs(h, gram), runs(h, window), w.first
    pick = chosen(grams, window - gram + 1)
    ok = np.flatnonzero(w.counts >= window)
    for i in ok:
        a, b = first[i], first[i] + w.counts[i] - window + 1
        yield i, a, wins[a:b], pick[a:b], grams


def _anchors(window: int, gram: int):
    """Texts -> their different anchors and how often each stands there; texts without a window give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.select(["k1", "k2", "doc"])
            for block in blocks(batch.column("text")):
                row, values, times, counts = [], [], [], []
                for i, _, _, pick, grams in _per_text(block, window, gram):
                    own, n = np.unique(grams[np.unique(pick)], return_counts=True)
                    row.append(block.first + i)
                    values.append(own)
                    times.append(n.astype(np.int32))
                    counts.append(len(own))
                if row:
                    part = named.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, lists(np.concatenate(values).view(np.int64), counts), lists(np.concatenate(times), counts)],
                        names=["k1", "k2", "doc", "grams", "times"],
                    )

    return run


def _extend(window: int, gram: int):
    """Rows of texts and their repeated anchors -> one row for each such anchor with its windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, named = batch.column("seeds"), batch.select(["k1", "k2", "copies"])
            for block in blocks(batch.column("text")):
                row, place, start, values, counts, names = [], [], [], [], [], []
                for i, a, wins, pick, grams in _per_text(block, window, gram):
                    own = pick - a
                    runs_at = np.flatnonzero(np.diff(own, prepend=-1))
                    length = np.diff(runs_at, append=len(own))
                    keep = np.isin(grams[pick[runs_at]].view(np.int64), wanted[block.first + i].values.to_numpy())
                    for s, n in zip(runs_at[keep], length[keep]):
                        row.append(block.first + i)
                        start.append(s)
                        counts.append(n)
                        values.append(wins[s : s + n])
                        names.append(grams[own[s] + a])
                if row:
                    part = named.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("k1"), part.column("k2"), part.column("copies"), pa.array(np.array(start, np.int32)), lists(np.concatenate(values).view(np.int64), counts)],
                        names=["k1", "k2", "copies", "start", "wins"],
                    )

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The repeated windows of each text of ``docs`` (doc_id, text).

    Returns (k1, k2, copies, spans): one row for each different text that has repeated windows, where
    ``spans`` are (start, len): windows start at words start ... start + len - 1.  A text that stands
    more than once has ``copies`` > 1 and no spans; all its windows are repeated.
    """
    texts = docs.select(F.col("doc_id").alias("doc"), *_keyed())
    found = texts.mapInArrow(_anchors(window, gram), "k1 long, k2 long, doc long, grams array<long>, times array<int>")
    # One row for each different text; a copy adds a count only, before the shuffle.
    each = stored(
        found.groupBy("k1", "k2").agg(
            F.count("*").alias("copies"), F.min("doc").alias("rep"), F.first("grams").alias("grams"), F.first("times").alias("times")
        ),
        "repeat-anchors",
    )
    anchors = each.select("k1", "k2", F.explode(F.arrays_zip("grams", "times")).alias("a")).select("k1", "k2", "a.grams", "a.times")
    shared = anchors.groupBy("grams").agg(F.sum("times").alias("n")).where("n > 1").select("grams")
    seeds = anchors.select("k1", "k2", "grams").join(shared, "grams").groupBy("k1", "k2").agg(F.collect_list("grams").alias("seeds"))
    seeds = seeds.join(each.select("k1", "k2", "copies", "rep"), ["k1", "k2"])
    sown = texts.alias("t").join(
        seeds.alias("s"), (F.col("t.k1") == F.col("s.k1")) & (F.col("t.k2") == F.col("s.k2")) & F.col("t.doc").eqNullSafe(F.col("s.rep"))
    )
    extended = stored(
        sown.select("t.k1", "t.k2", "s.copies", "s.seeds", "t.text").mapInArrow(
            _extend(window, gram), "k1 long, k2 long, copies long, start int, wins array<long>"
        ),
        "repeat-extensions",
    ).withColumns({"c1": F.xxhash64("wins"), "c2": F.element_at("wins", 1)})
    # Equal extensions count as one; what is left are those with a context of their own.
    contexts = extended.groupBy("c1", "c2").agg(
        F.sum("copies").alias("n"), F.first("wins").alias("wins"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("start").alias("start")
    )
    contexts = stored(contexts, "repeat-contexts")
    single = contexts.select("n", "k1", "k2", "start", F.posexplode("wins").alias("off", "win"))
    twice = single.groupBy("win").agg(F.sum("n").alias("m")).where("m > 1").select("win")
    part = single.where("n = 1").join(twice, "win").select("k1", "k2", (F.col("start") + F.col("off")).alias("start"), F.lit(1).alias("len"))
    whole = (
        extended.where("copies = 1")
        .join(contexts.where("n > 1").select("c1", "c2"), ["c1", "c2"])
        .select("k1", "k2", "start", F.size("wins").alias("len"))
    )
    spans = part.union(whole).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "len")).alias("spans"))
    return each.select("k1", "k2", "copies").join(spans, ["k1", "k2"], "left").where("copies > 1 or spans is not null")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, spans = batch.column("copies"), batch.column("spans")
            starts, lens = spans.values.field("start").to_numpy(), spans.values.field("len").to_numpy()
            limits = spans.offsets.to_numpy()
            for block in blocks(batch.column("text")):
                w = words(block)
                first, raw = w.first, block.data.tobytes()
                removed, digests, kept_texts, merged = [], [], [], []
                for i in range(block.rows):
                    a, n, r = first[i], int(w.counts[i]), block.first + i
                    step = np.zeros(n + 1, dtype=np.int64)
                    if (copies[r].as_py() or 1) > 1 and n >= window:
                        step[0], step[n] = 1, -1
                    elif spans.is_valid()[r].as_py():
                        own = slice(limits[r], limits[r + 1])
                        np.add.at(step, starts[own], 1)
                        np.add.at(step, starts[own] + lens[own] - 1 + window, -1)
                    gone = np.cumsum(step[:n]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    kept = np.flatnonzero(~gone) + a
                    if len(edges):
                        text = b" ".join([raw[s:e] for s, e in zip(w.start[kept].tolist(), w.end[kept].tolist())])
                    else:
                        text = b" ".join(raw[block.bounds[i] : block.bounds[i + 1]].split())
                    kept_texts.append(text.decode())
                    digests.append(hashlib.sha256(text).hexdigest())
                    removed.append(int(gone.sum()))
                    merged.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                        pa.array(kept_texts, pa.string()), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed_spans"],
                )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove from ``docs`` (doc_id, text) the words of every window of ``window`` words that stands elsewhere too.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined
    by one space) and removed_spans (start, end: word numbers).  Null and empty texts have no words;
    texts shorter than a window lose none; rows that repeat a text, even with the same or a null
    doc_id, are copies of each other and lose all their words; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(docs, window, gram)
    joined = docs.select("doc_id", *_keyed()).join(spans, ["k1", "k2"], "left").select(
        "doc_id", "text", "copies", F.col("spans").cast("array<struct<start:int,len:int>>").alias("spans")
    )
    return joined.mapInArrow(
        _cut(window),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed_spans array<struct<start:int,end:int>>",
    )
