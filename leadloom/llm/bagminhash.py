"""Near-duplicate documents by BagMinHash over multisets of word shingles (operator 3).

A shingle that stands c times has weight c.  Its weight axis is cut at 0, 1, 2, 4, 8 ... and each cut
interval carries a Poisson process over (hash value, weight) whose rate is the interval's length.  A
process is shared by all documents that hold the shingle; a document accepts the points whose weight
is at most its own, so only the last interval needs thinning.  Points come in ascending order and a
process is left as soon as it passes the largest value in the signature, so most shingles cost one
draw.  Two signatures agree at a place with the probability of the weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .store import small_batches, stored
from .textblocks import Block, blocks, lists, mix, mix_int, runs, span_hashes, words

WORDS, THRESHOLD_TENTHS = 5, 8
BANDS, BAND_ROWS = 24, 4
#: A shingle in at most so many sets is rare; any value gives the same links.
RARE = 32
_U = np.uint64


def shingles(block: Block, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, times) of the different shingles; fewer than ``n`` words are one shingle."""
    w = words(block)
    h = span_hashes(block.data, w.start, w.end)
    first = w.first
    whole = runs(h, n)
    left = first[1:][w.doc] - np.arange(len(h))
    at = np.flatnonzero(left >= n)
    doc, value = [w.doc[at]], [whole[at]]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    for k in range(1, n):
        own = short[w.counts[short] == k]
        if len(own):
            doc.append(own)
            value.append(runs(h, k)[first[own]])
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(at, append=len(doc))


def signatures(doc: np.ndarray, value: np.ndarray, times: np.ndarray, rows: int, size: int) -> np.ndarray:
    """BagMinHash signatures of ``rows`` documents; a document without shingles keeps infinities."""
    levels = np.ceil(np.log2(np.maximum(times, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), levels + 1)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels + 1) - (levels + 1), levels + 1)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low)
    key = mix(value[at] + level.astype(_U) * _U(0x9E3779B97F4A7C15))
    doc, limit = doc[at], times[at]
    point = np.zeros(len(at))
    out = np.full(rows * size, np.inf)
    top = np.full(rows, np.inf)
    draw = 0
    while len(doc):
        draw += 1
        bits = mix(key + _U(mix_int(draw)))
        point = point - np.log1p(-((bits >> _U(11)).astype(np.float64) * 2.0**-53)) / width
        on = point < top[doc]
        doc, key, point, low, width, limit, bits = doc[on], key[on], point[on], low[on], width[on], limit[on], bits[on]
        more = mix(bits ^ _U(0x5851F42D4C957F2D))
        cell = low + 1 + ((more >> _U(32)) % width.astype(_U)).astype(np.int64)
        fits = cell <= limit
        place = doc * size + ((more & _U(0xFFFFFFFF)) % _U(size)).astype(np.int64)
        np.minimum.at(out, place[fits], point[fits])
        top = out.reshape(rows, size).max(axis=1)
    return out.reshape(rows, size)


def _bands(n: int, bands: int, band_rows: int):
    size = bands * band_rows
    seeds = np.array([mix_int(1000 + k) for k in range(size)], dtype=_U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                doc, value, times = shingles(block, n)
                sig = signatures(doc, value, times, block.rows, size)
                keys = mix(sig.view(_U) ^ seeds).reshape(block.rows, bands, band_rows)
                keys = mix(keys.sum(axis=2, dtype=_U) + np.arange(bands, dtype=_U))
                weight = np.bincount(doc, times, block.rows).astype(np.int64)
                some = np.flatnonzero(weight)
                part = batch.select(["doc_id", "k1", "k2"]).take(pa.array(block.first + some))
                own = [part.column("doc_id"), part.column("k1"), part.column("k2")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(weight[some]), lists(keys[some].view(np.int64).ravel(), np.full(len(some), bands))],
                    names=["doc_id", "k1", "k2", "weight", "bands"],
                )

    return run


def _elements(n: int):
    """Texts -> the hashes of (shingle, 1), (shingle, 2) ...: a set whose overlaps are those of the multisets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                doc, value, times = shingles(block, n)
                at = np.repeat(np.arange(len(doc)), times)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                own = mix(value[at] + nth.astype(_U) * _U(0xD1342543DE82EF95))
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), lists(own.view(np.int64), np.bincount(doc, times, block.rows).astype(np.int64))], names=["node", "elements"]
                )

    return run


def near_duplicates(docs: DataFrame, n: int = WORDS, tenths: int = THRESHOLD_TENTHS, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Classes of documents whose multisets of ``n``-word shingles overlap by ``tenths`` / 10 or more.

    ``docs`` (doc_id, text).  Returns one row per input row: doc_id, class_id (the smallest doc_id that
    links reach), n_links (other different texts linked directly as verified) and kept (doc_id = class_id).
    Equal texts are one node.  A null or empty text, or one of white space alone, links with nothing; a
    null doc_id stays null, links with nothing and is kept.  Rows that repeat a doc_id share its class.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.where("doc_id is not null and text is not null").select("doc_id", *_keys(), "text")
    banded = stored(named.mapInArrow(_bands(n, bands, band_rows), "doc_id long, k1 long, k2 long, weight long, bands array<long>"), "near-bands")
    each = stored(banded.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "near-texts")
    first_rows = each.withColumnRenamed("node", "doc_id")
    signed_texts = banded.join(first_rows, ["k1", "k2", "doc_id"], "left_semi").withColumnRenamed("doc_id", "node")
    slots = stored(signed_texts.select("node", "weight", F.explode("bands").alias("slot")), "near-slots")

    # Each member of a slot is compared with the slot's smallest member.
    sizes = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    # Slots with company; what follows, and its tables, covers their members only.
    shared = stored(slots.join(sizes, "slot"), "near-shared")
    # A slot's centre is the member with the most company in all its slots, so the original of many copies.
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    shared = stored(shared.join(company, "node").select("slot", "node", "weight", "company"), "near-company")
    centres = shared.groupBy("slot").agg(F.min(F.struct(-F.col("company"), "node", "weight")).alias("centre"))
    stars = (
        shared.join(centres, "slot")
        .select(F.col("centre.node").alias("a"), F.col("centre.weight").alias("wa"), F.col("node").alias("b"), F.col("weight").alias("wb"))
        .where(F.col("a") != F.col("b"))
        .where(_sizes_fit(tenths))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    stars = stored(stars, "near-stars")
    nodes = shared.select("node").distinct()
    sets = stored(
        _texts_of(named, each.join(nodes, "node", "left_semi")).mapInArrow(_elements(n), "node long, elements array<long>"), "near-elements"
    )
    links = stored(_verified(stars, sets, tenths), "near-links")
    first = components(links, "near-stars")

    # Then members of one slot that stars left in different components.
    labelled = shared.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("slot").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("slot")
    open_slots = stored(labelled.join(mixed, "slot").select("slot", "node", "weight", "component"), "near-open")
    rest = _unstarred(open_slots, signed_texts, sets, tenths).join(stars, ["a", "b"], "left_anti")
    more = stored(_verified(stored(rest, "near-rest"), sets, tenths), "near-more")
    links = links.union(more)
    final = components(links, "near-all") if more.limit(1).count() else first
    ends = links.select(F.col("a").alias("node")).union(links.select("b"))
    classes = final.join(ends.groupBy("node").agg(F.count("*").alias("n_links")), "node")
    per_text = each.join(classes, "node", "left").select(
        "k1", "k2", F.coalesce("component", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    # Texts without words are no copies of each other.
    worded = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0
    keyed = rows.select("doc_id", *_keys(), F.coalesce(worded, F.lit(False)).alias("worded"))
    out = keyed.join(per_text, ["k1", "k2"], "left")
    own = F.when(F.col("worded") & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))
    )


def _unstarred(open_slots: DataFrame, signed_texts: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar enough; misses none that share a slot.

    Order each set's elements by how many open sets hold them.  Two similar sets share an element in the
    first few of that order.  If the first shared one is rare (in at most RARE sets), a join on rare
    elements of these prefixes finds the pair; else they share common elements alone, and at most the
    smaller number of those, which most members of one slot fail by.
    """
    nodes = open_slots.select("node", "weight", "component").distinct()
    elements = sets.join(nodes, "node").select("node", "weight", "component", F.explode("elements").alias("e"))
    held = elements.groupBy("e").agg(F.count("*").alias("held"))
    elements = elements.join(held, "e")
    order = Window.partitionBy("node").orderBy("held", "e")
    # Of w elements, similar sets share tenths / 10 * w: one of the first w - that + 1 is among them.
    prefix = elements.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("weight") - F.ceil(F.col("weight") * tenths / 10) + 1)
    prefix = stored(prefix.where(F.col("held").between(2, RARE)).select("e", "node", "weight", "component"), "near-rare")
    common = elements.groupBy("node").agg(F.count_if(F.col("held") > RARE).alias("common"))
    core = open_slots.join(common, "node").where(F.col("common") * 10 >= F.col("weight") * tenths)
    core = stored(core.join(signed_texts.select("node", "bands"), "node"), "near-core")

    def pairs(rows: DataFrame, key: str, fits: Column) -> DataFrame:
        one, two = rows.alias("x"), rows.alias("y")
        names = {"a": "x.node", "wa": "x.weight", "b": "y.node", "wb": "y.weight"}
        joined = one.join(two, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.component") < F.col("y.component")) & fits)
        return joined.select(*(F.col(v).alias(k) for k, v in names.items()))

    weights = F.col("x.weight") + F.col("y.weight")
    enough = F.least("x.common", "y.common") * (10 + tenths) >= weights * tenths
    # Of the slots that two sets share, the first alone gives the pair.
    enough = enough & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.slot"))
    found = pairs(prefix, "e", F.least("x.weight", "y.weight") * 10 >= F.greatest("x.weight", "y.weight") * tenths).union(pairs(core, "slot", enough))
    return found.where(_sizes_fit(tenths)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _keys() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2")]


def _texts_of(named: DataFrame, each: DataFrame) -> DataFrame:
    """The texts of some nodes, each from the row that gave the node its number."""
    n, e = named.alias("n"), each.alias("e")
    same = (F.col("n.doc_id") == F.col("e.node")) & (F.col("n.k1") == F.col("e.k1")) & (F.col("n.k2") == F.col("e.k2"))
    return n.join(e, same, "left_semi").select(F.col("n.doc_id").alias("node"), "n.text")


def _sizes_fit(tenths: int) -> Column:
    """A similarity needs at least this share of weights."""
    return F.least("wa", "wb") * 10 >= F.greatest("wa", "wb") * tenths


def _verified(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(right, "b").join(left, "a").where(both * 10 >= (F.size("ea") + F.size("eb") - both) * tenths).select("a", "b").distinct()
