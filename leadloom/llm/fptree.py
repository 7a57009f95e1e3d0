"""Ranked lexical search over trees of term vectors (operator 11).

Only terms of the items matter, so a document is the vector of those that it holds, most frequent
first.  The vectors of a block of documents share the paths of a trie; paths without a branch are one
edge.  A node knows for each term below it the largest tf of its documents, and the smallest m: scored
as if one document had them all, they bound every score below.  An item goes down the trie depth first,
the best children first and some of them at a time, and leaves out what cannot come among its best any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import small_batches, stored
from .textblocks import BLOCK_BYTES, Block, blocks, lists, words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
#: Terms of the items that are searched for together, about: what travels with a task.
ITEM_TERMS = 1 << 16
#: Documents, and entries of their vectors, that share a trie.
TREE_DOCS, TREE_ENTRIES = 1 << 14, 1 << 19
#: Nodes that a search opens at a time, the best ones of its stack: at first, and after some doublings;
#: fewer for an item with many terms, so that nodes times terms stay bounded.
FIRST_WAVE, LAST_WAVE, WAVE_TERMS = 4, 32, 1 << 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = np.iinfo(np.int64).max

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(text: Column) -> Column:
    """The terms of a text in their order."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def _sliced(block: Block, limit: int) -> Iterator[Block]:
    """A block of one long text in slices that cut no term; other blocks as they are."""
    n, begin = len(block.data), 0
    if block.rows > 1 or n <= limit:
        yield block
        return
    while begin < n:
        stop, size = n, limit
        while begin + size < n:
            between = np.flatnonzero(_BETWEEN[block.data[begin : begin + size]])
            if len(between):
                stop = begin + int(between[-1]) + 1
                break
            size *= 2
        yield Block(block.first, block.data[begin:stop], np.array([0, stop - begin]))
        begin = stop


def _vectors(vocabulary: list[str], limit: int = BLOCK_BYTES):
    """Batches of (doc_id, text) -> doc_id, n, and the terms of the vocabulary (their numbers) with their tf."""
    known = pa.array([t.encode() for t in vocabulary], pa.binary())

    def counted(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text, keys text * vocabulary + term of those known, their numbers)."""
        w = words(block, _BETWEEN)
        ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
        solid = np.ascontiguousarray(block.data[~_BETWEEN[block.data]])
        spans = pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(solid)])
        place = pc.index_in(spans, value_set=known.cast(pa.large_binary())).fill_null(-1).to_numpy(zero_copy_only=False)
        held = place >= 0
        keys, times = np.unique(w.doc[held] * len(vocabulary) + place[held], return_counts=True)
        return w.counts, keys, times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                parts = [counted(s) for s in _sliced(block, limit)] or [counted(block)]
                keys, at = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True)
                tf = np.zeros(len(keys), np.int64)
                np.add.at(tf, at, np.concatenate([t for _, _, t in parts]))
                doc = keys // len(vocabulary)
                per = np.bincount(doc, minlength=block.rows)
                ids = batch.column("doc_id").slice(block.first, block.rows)
                n = pa.array(sum(c for c, _, _ in parts).astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids, n, lists((keys % len(vocabulary)).astype(np.int32), per), lists(tf, per)], names=["doc_id", "n", "terms", "tfs"])

    return run


def weight(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds: more for a larger tf, less for a larger m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Tree:
    """The trie of a block.  Children of a node are numbered one after another; documents are in the order of their vectors.

    ``child``: the first child of each node, and of the next; ``low``, ``high``: its documents; ``m``, ``ids``: their
    least values; ``keys``: term * nodes + node, sorted, for all terms below a node; ``most``: the largest tf there.
    """

    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    m: np.ndarray
    ids: np.ndarray
    keys: np.ndarray
    most: np.ndarray
    doc_ids: np.ndarray
    doc_m: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    tfs: np.ndarray
    n_terms: int

    @property
    def nodes(self) -> int:
        return len(self.low)


def _intervals(vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, low, high) of the nodes over sorted vectors of 4-byte terms: a root, branches, and a leaf for each different vector."""
    parent, low, high = [-1], [0], [len(vectors)]
    path, depth = [0], [0]  # open nodes and the numbers of their common bytes

    def add(at: int, up: int) -> int:
        parent.append(up)
        low.append(at)
        high.append(0)
        return len(parent) - 1

    k = 0
    while k < len(vectors):
        end = k + 1
        while end < len(vectors) and vectors[end] == vectors[k]:
            end += 1
        leaf = add(k, path[-1])
        high[leaf] = end
        if end < len(vectors):
            a, b = vectors[k], vectors[end]
            n = min(len(a), len(b))
            if a[:n] == b[:n]:
                common = n
            else:
                x, y = np.frombuffer(a[:n], np.uint32), np.frombuffer(b[:n], np.uint32)
                common = 4 * int(np.argmax(x != y))
            last = leaf
            while depth[-1] > common:
                last = path.pop()
                depth.pop()
                high[last] = end
            if depth[-1] < common:
                branch = add(low[last], path[-1])
                parent[last] = branch
                path.append(branch)
                depth.append(common)
        k = end
    for node in path:
        high[node] = len(vectors)
    return np.array(parent), np.array(low), np.array(high)


def tree(doc_ids: np.ndarray, m: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int) -> Tree:
    """The trie of documents whose vectors, ``counts`` entries each, hold terms by falling frequency (0 the most frequent)."""
    first = np.concatenate([[0], np.cumsum(counts)])
    raw = terms.astype(">u4").tobytes()
    vectors = [raw[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    order = np.array(sorted(range(len(vectors)), key=lambda k: (vectors[k], doc_ids[k])), dtype=np.int64)
    parent, low, high = _intervals([vectors[k] for k in order])
    # Number the nodes level by level, those of one parent together.
    level = np.zeros(len(parent), np.int64)
    at, up = np.flatnonzero(parent >= 0), parent.copy()
    while len(at):
        level[at] += 1
        up[at] = parent[up[at]]
        at = at[up[at] >= 0]
    place = np.zeros(len(parent), np.int64)
    numbered = np.array([0])
    for depth in range(1, int(level.max()) + 1):
        own = np.flatnonzero(level == depth)
        own = own[np.lexsort((low[own], place[parent[own]]))]
        place[own] = len(numbered) + np.arange(len(own))
        numbered = np.concatenate([numbered, own])
    parent, level, low, high = np.where(parent[numbered] >= 0, place[parent[numbered]], -1), level[numbered], low[numbered], high[numbered]
    child = 1 + np.searchsorted(parent[1:], np.arange(len(parent) + 1))
    counts = counts[order]
    take = np.repeat(first[order] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    own_first, own_terms, own_tfs = np.concatenate([[0], np.cumsum(counts)]), terms[take].astype(np.int64), tfs[take]
    leaves = np.flatnonzero(child[1:] == child[:-1])
    leaf = np.repeat(leaves[np.argsort(low[leaves])], (high - low)[leaves[np.argsort(low[leaves])]])
    node, term, most = np.repeat(leaf, counts), own_terms, own_tfs
    keys, values = [], []
    for depth in range(int(level.max()), -1, -1):
        here = level[node] == depth
        key, inverse = np.unique(node[here] * n_terms + term[here], return_inverse=True)
        top = np.zeros(len(key), np.int64)
        np.maximum.at(top, inverse, most[here])
        keys.append(key)
        values.append(top)
        node = np.concatenate([node[~here], parent[key // n_terms]])
        term, most = np.concatenate([term[~here], key % n_terms]), np.concatenate([most[~here], top])
    key, value = np.concatenate(keys), np.concatenate(values)
    key = key % n_terms * len(low) + key // n_terms
    by = np.argsort(key)
    least = lambda x: np.minimum.reduceat(np.append(x, _NO_ID), np.stack([low, high], 1).ravel())[::2]
    return Tree(child, low, high, least(m[order]), least(doc_ids[order]), key[by], value[by], doc_ids[order], m[order], own_first, own_terms, own_tfs, n_terms)


class Best:
    """The best documents of an item so far: by score, then by id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def open(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of these may still come in."""
        if len(self.scores) < self.k:
            return scores > 0
        return (scores > self.scores[-1]) | ((scores == self.scores[-1]) & (ids < self.ids[-1]))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        by = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[by], ids[by]


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places from each ``low`` to before each ``high``, and which of these it was."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(low)), n)


def _leaf_scores(t: Tree, leaves: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the documents of leaves; ``own``: the weight of each term, 0 if not asked for."""
    docs, _ = _spans(t.low[leaves], t.high[leaves])
    place, which = _spans(t.first[docs], t.first[docs + 1])
    held = np.flatnonzero(own[t.terms[place]])
    place, which = place[held], which[held]
    scores = np.zeros(len(docs), np.int64)
    np.add.at(scores, which, share(t.tfs[place], t.doc_m[docs[which]]) * own[t.terms[place]])
    return scores, t.doc_ids[docs]


def _bounds(t: Tree, a: np.ndarray, b: np.ndarray, item_terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, bounds) of all children, from each of ``a`` (rising) to before each of ``b``."""
    nodes, _ = _spans(a, b)
    base = (item_terms * t.nodes)[:, None]
    place, which = _spans(np.searchsorted(t.keys, (base + a).ravel()), np.searchsorted(t.keys, (base + b).ravel()))
    term, parent = np.divmod(which, len(a))
    node = t.keys[place] - base[term, 0]
    bounds = np.zeros(len(nodes), np.int64)
    np.add.at(bounds, node - (a - np.cumsum(b - a) + b - a)[parent], share(t.most[place], t.m[node]) * weights[term])
    return nodes, bounds


def search(t: Tree, item_terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Offer ``best`` what the documents of a tree have for an item (terms and their weights); returns the number of nodes opened."""
    own = np.zeros(t.n_terms, np.int64)
    own[item_terms] = weights
    opened, last = 0, max(1, min(LAST_WAVE, WAVE_TERMS // len(item_terms)))
    wave = min(FIRST_WAVE, last)
    stack, bound = np.zeros(1, np.int64), np.full(1, _NO_ID)
    while len(stack):
        top, stack = stack[-wave:], stack[:-wave]
        ok = best.open(bound[-wave:], t.ids[top])
        top, bound = np.sort(top[ok]), bound[:-wave]
        if not len(top):
            continue
        opened, wave = opened + len(top), min(2 * wave, last)
        a, b = t.child[top], t.child[top + 1]
        if (a == b).any():  # documents of one vector
            scores, ids = _leaf_scores(t, top[a == b], own)
            ok = best.open(scores, ids)
            best.offer(scores[ok], ids[ok])
            a, b = a[a < b], b[a < b]
        nodes, bounds = _bounds(t, a, b, item_terms, weights)
        ok = best.open(bounds, t.ids[nodes])
        nodes, bounds = nodes[ok], bounds[ok]
        alone = t.high[nodes] - t.low[nodes] == 1  # the bound of one document is its score
        best.offer(bounds[alone], t.ids[nodes[alone]])
        nodes, bounds = nodes[~alone], bounds[~alone]
        by = np.lexsort((-t.ids[nodes], bounds))
        stack, bound = np.concatenate([stack, nodes[by]]), np.concatenate([bound, bounds[by]])
    return opened


def _search(items: list[tuple[np.ndarray, np.ndarray]], frequency: np.ndarray, n_docs: int, n_all: int, k: int):
    """Batches of vectors -> (item, score, doc_id): the best of all documents of a task for each item."""
    rank = np.empty(len(frequency), np.int64)
    rank[np.argsort(-frequency, kind="stable")] = np.arange(len(frequency))
    weights = weight(frequency, n_docs)
    asked = []
    for terms_, times in items:
        own = rank[terms_]
        by = np.argsort(own)
        useful = by[weights[terms_[by]] > 0]
        asked.append((own[useful], weights[terms_[useful]] * times[useful]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        held: list[tuple] = []

        def settle() -> None:
            if not held:
                return
            ids, n, counts, terms_, tfs = (np.concatenate(c) for c in zip(*held))
            held.clear()
            doc = np.repeat(np.arange(len(ids)), counts)
            by = np.lexsort((rank[terms_], doc))
            made = tree(ids, 75 + (25 * n * n_docs) // n_all, counts, rank[terms_[by]], tfs[by], len(frequency))
            for (own, ws), b in zip(asked, best):
                if len(own):
                    search(made, own, ws, b)

        docs = entries = 0
        for batch in batches:
            own, tf = batch.column("terms"), batch.column("tfs")
            counts = np.diff(own.offsets.to_numpy()).astype(np.int64)
            ids = batch.column("doc_id").fill_null(int(_NO_ID)).to_numpy()
            held.append((ids, batch.column("n").to_numpy(), counts, own.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)))
            docs, entries = docs + len(ids), entries + int(counts.sum())
            if docs >= TREE_DOCS or entries >= TREE_ENTRIES:
                settle()
                docs = entries = 0
        settle()
        item = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        scores, ids = (np.concatenate([getattr(b, c) for b in best] or [np.zeros(0, np.int64)]) for c in ("scores", "ids"))
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(scores), pa.array(ids, mask=ids == _NO_ID)], names=["item", "score", "doc_id"])

    return run


def vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (all terms with repeats), terms and tfs of the vocabulary's terms, for every row of ``docs``; no shuffle."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_vectors(vocabulary), "doc_id long, n long, terms array<int>, tfs array<bigint>")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Items are searched for in blocks of about ``ITEM_TERMS`` terms, whose terms and numbers travel with the
    tasks; each block reads all documents.  A null or empty text has no terms and meets nothing; rows of
    equal id and text are one item, those of one id and different texts an item each; every document row
    counts for itself, so repeated ones stand in a ranking side by side; documents without an id come
    behind equal ones that have one; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    found = each.select("item_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), F.explode(terms(F.col("text"))).alias("term"))
    asked = stored(found.groupBy("item_id", "h1", "h2", "term").agg(F.count("*").alias("times")), "search-items")
    n_blocks = -(-asked.count() // ITEM_TERMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in range(n_blocks):
        out = out.union(_ranked_block(docs, asked.where(F.pmod(F.xxhash64("item_id", "h1", "h2"), F.lit(n_blocks)) == number), k))
    return out


def _ranked_block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark, rows = docs.sparkSession, asked.collect()
    vocabulary = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    names: dict[tuple, list] = {}
    for r in rows:
        names.setdefault((r["item_id"], r["h1"], r["h2"]), []).append((number[r["term"]], r["times"]))
    items = [tuple(np.array(c, np.int64) for c in zip(*pairs)) for pairs in names.values()]
    given = stored(vectors(docs, vocabulary), "search-vectors")
    sums = given.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    frequency = np.zeros(max(1, len(vocabulary)), np.int64)
    for r in given.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        frequency[r["term"]] = r["df"]
    some = given.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs")
    local = some.mapInArrow(_search(items, frequency, sums["docs"], max(1, sums["all"]), k), "item int, score long, doc_id long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = local.withColumn("rank", place).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, key[0]) for i, key in enumerate(names)], "item int, item_id long")
    return best.join(ids, "item").select("item_id", "rank", "doc_id", "score")
