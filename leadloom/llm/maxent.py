"""LM scoring by a hashed maximum-entropy model with a class-factored softmax (operator 9).

P(word | history) = P(class | history) P(word | class, history).  The ``TOP`` most frequent words are
leaves of a tree below the classes: the first classes hold ``WIDE`` words each, later ones ``WIDE`` groups of
``WIDE`` words, the last ones a level more; the words beyond and the unseen one share one class by their
smoothed counts.  Each choice on the way to a word is a softmax whose logits are a bias and the weights
of hashed features of the history, at every choice the last word, the last two and the last but one (a
skip): at the root each in rows of its own, below it in rows of the node.

Biases are the smoothed unigram model.  In each round all learning tokens give, for each weight, how often
its feature and choice were observed and how often they were drawn: each token draws one choice at each
of its nodes from the model's shares, so the difference is an unbiased estimate of the gradient.  These
whole numbers are summed over all partitions, and each weight takes the step of iterative scaling along its
gradient.  Draws are keyed by text and place, so the weights do not depend on the partitions (but for the last
digits of a batch's products), and more text means better known gradients.  In the first round every history gives the same shares, so it needs
no softmax, and at the root no draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashindex import HashIndex
from .language import fold
from .store import small_batches, stored
from .textblocks import Block, blocks, lists, mix, mix_int, span_hashes, words

#: Words in the tree, which every task holds, and choices at a node below the root.
TOP, WIDE = 1 << 18, 32
#: Classes by rank: how many, and levels below them.
LEVELS = ((32, 1), (4, 2), (8, 3))
DEEPEST = 3
#: Features, rows of the hashed tables at the root and below it (parameters of the model, as in any hashed one), rounds.
FEATURES, BUCKETS, INNER_BUCKETS, ROUNDS, BATCH = 3, 1 << 15, 3 << 15, 2, 1 << 14
#: Counts that are added to what a weight has observed and expected: in the first round at the root (times the
#: class's share) and below it, and in later ones, where draws are noise beside what is left to learn; largest step.
PRIOR, INNER_PRIOR, LATER, LONGEST = 300.0, 1.0, 10.0, 2.0
#: What a step is divided by at the root and below it: somewhat less than the features, which overlap, ask for at most.
DAMPED, INNER_DAMPED = 2.0, 1.5
_U = np.uint64
END, _NONE = mix_int(0x656E64), mix_int(0x6E6F6E65)
_ROWS = 256  # of a table in a shuffled slab
_SLABS = 64  # in a batch of them


@dataclass
class Lexicon:
    """The counts: ``top`` hashes and ``count`` of the TOP most frequent words, by rank; totals of all."""

    top: np.ndarray
    count: np.ndarray
    tokens: int
    types: int

    def __post_init__(self):
        self.whole = self.tokens + self.types + 1
        self.index = HashIndex(self.top)
        self.classes = sum(n for n, _ in LEVELS) + 1

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tree"}

    @cached_property
    def _tree(self):
        """(class, nodes, choices) by rank, and the smoothed mass of each choice at each node; rank -1: the last class."""
        n = len(self.top)
        cls, node, choice = np.full(n + 1, self.classes - 1, np.int64), np.full((DEEPEST, n + 1), -1, np.int64), np.zeros((DEEPEST, n + 1), np.int64)
        rank, first_class, nodes = 0, 0, 0
        for classes, depth in LEVELS:
            size = WIDE**depth
            at = np.arange(rank, min(n, rank + classes * size))
            own, place = (at - rank) // size, (at - rank) % size
            cls[at] = first_class + own
            for j in range(depth):
                span = WIDE ** (depth - j - 1)
                node[j, at] = nodes + own * WIDE**j + place // (span * WIDE)
                choice[j, at] = place // span % WIDE
                nodes += classes * WIDE**j
            rank, first_class = rank + classes * size, first_class + classes
        weight = self.count.astype(np.float64) + 1
        mass = np.zeros((nodes, WIDE))
        for j in range(DEEPEST):
            at = np.flatnonzero(node[j] >= 0)
            np.add.at(mass, (node[j, at], choice[j, at]), weight[at])
        by_class = np.bincount(cls[:n], weight, self.classes)
        by_class[-1] += self.whole - weight.sum()
        # Each node has rows of its own in the inner table, as many as its share of the tokens asks for.
        spare = INNER_BUCKETS - nodes
        share = mass.sum(axis=1) / max(mass.sum(), 1)
        size = 1 + np.floor(share * spare).astype(np.int64)
        return cls, node, choice, by_class, mass, np.cumsum(size) - size, size

    def inner_rows(self, keys: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Rows of phi for keys at nodes."""
        begin, size = self._tree[5:]
        # A multiple of a hash's upper half instead of a remainder.
        part = (keys >> _U(32)).astype(np.int64) * size[node][:, None] >> 32
        return begin[node][:, None] + part

    @property
    def owner(self) -> np.ndarray:
        """The node of each row of phi; rows that none has: the last."""
        size = self._tree[6]
        return np.append(np.repeat(np.arange(len(size)), size), np.full(INNER_BUCKETS - size.sum(), len(size) - 1))

    def path(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class; node and choice at each level below it, node -1: none) of each rank."""
        cls, node, choice = self._tree[:3]
        return cls[rank], node[:, rank], choice[:, rank]

    @property
    def rest(self) -> float:
        """The smoothed mass of the last class: the words beyond the tree and one unseen."""
        return float(self._tree[3][-1])

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """Biases at the root and at each node."""
        with np.errstate(divide="ignore"):
            return tuple(np.maximum(np.log(m / max(m.sum(), 1)), -50.0).astype(np.float32) for m in self._tree[3:5])


def token_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens of each text): the words and then one end."""
    w = words(block)
    h = span_hashes(block.data, w.start, w.end)
    counts = w.counts + 1
    out = np.empty(len(h) + block.rows, dtype=_U)
    ends = np.cumsum(counts) - 1
    other = np.ones(len(out), dtype=bool)
    other[ends] = False
    out[ends], out[other] = _U(END), h
    return out, counts


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, n, len(keys)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a partition; beyond a million different words what there is goes on to the shuffle."""
    parts, held = [], 0

    def give():
        keys, n = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        for block in blocks(batch.column("text"), lower=True):
            keys, n = np.unique(token_hashes(block)[0], return_counts=True)
            parts.append((keys, n))
            held += len(keys)
            if held > 1_000_000:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > 500_000:
                    yield give()
                    parts, held = [], 0
    if parts:
        yield give()


def histories(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit keys of each token's features, one column each: the last word, the last two, the last but one."""
    begin = np.cumsum(counts) - counts
    last, before = np.full(len(hashes), _NONE, _U), np.full(len(hashes), _NONE, _U)
    last[1:], before[2:] = hashes[:-1], hashes[:-2]
    last[begin] = before[begin] = before[begin[counts > 1] + 1] = _U(_NONE)
    return np.stack([mix(last + _U(1)), mix(last * _U(0x9E3779B97F4A7C15) + before), mix(before + _U(3))], axis=1)


@dataclass
class Weights:
    by_class: np.ndarray  # bias
    in_node: np.ndarray  # bias
    theta: np.ndarray  # features' rows x classes
    phi: np.ndarray  # features' rows mixed with the node x WIDE

    @classmethod
    def new(cls, lexicon: Lexicon) -> Weights:
        return cls(*lexicon.start(), np.zeros((BUCKETS, lexicon.classes), np.float32), np.zeros((INNER_BUCKETS, WIDE), np.float32))


def outer_rows(keys: np.ndarray) -> np.ndarray:
    """Rows of theta: half of them for the last word, a quarter each for the last two and the last but one."""
    half, quarter = _U(BUCKETS // 2), _U(BUCKETS // 4)
    rows = np.empty(keys.shape, np.int64)
    rows[:, 0] = keys[:, 0] & half - _U(1)
    rows[:, 1] = half + (keys[:, 1] & quarter - _U(1))
    rows[:, 2] = half + quarter + (keys[:, 2] & quarter - _U(1))
    return rows


@lru_cache(maxsize=8)
def _buffer(width: int, use: str) -> np.ndarray:
    """Memory that batches of this width use again and again."""
    return np.empty((BATCH, width), np.float32)


def exponentials(table: np.ndarray, rows: np.ndarray, bias: np.ndarray, node: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each line of ``rows`` what is proportional to the shares of the choices, and its sum.

    ``bias``: one for all lines, or the lines ``node`` of a table.  The result holds until the next call.
    Logits are at most a few dozen, as each step of a weight is bounded, so no maximum is taken off first.
    """
    width = table.shape[1]
    x, more = (_buffer(width, use)[: len(rows)] for use in ("sum", "part"))
    np.take(table, rows[:, 0], axis=0, out=x, mode="clip")
    for k in range(1, rows.shape[1]):
        x += np.take(table, rows[:, k], axis=0, out=more, mode="clip")
    x += bias if node is None else np.take(bias, node, axis=0, out=more, mode="clip")
    np.exp(x, out=x)
    return x, x @ np.ones(width, np.float32)


def _shares(bias: np.ndarray) -> np.ndarray:
    x = np.exp(bias)
    return x / x.sum(axis=-1, keepdims=True)


def drawn(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The choice whose part of its line's sum holds the share ``u`` of it."""
    width = x.shape[1]
    sums = np.matmul(x, np.triu(np.ones((width, width), np.float32)), out=_buffer(width, "part")[: len(x)])
    return (sums > (sums[:, -1] * u)[:, None]).argmax(axis=1)


def randoms(hashes: np.ndarray, counts: np.ndarray, turn: int) -> np.ndarray:
    """A number from 0 to 1 for each level of each token, keyed by its text, its place and the round."""
    begin = np.cumsum(counts) - counts
    text = np.repeat(np.add.reduceat(hashes, begin), counts)
    x = mix(text + (np.arange(len(hashes)) - np.repeat(begin, counts) + (turn << 40)).astype(_U) * _U(0x9E3779B97F4A7C15))
    parts = [(x >> _U(16 * k)) & _U(0xFFFFFF) for k in range(DEEPEST)] + [mix(x) >> _U(40)]
    return np.stack(parts).astype(np.float32) * np.float32(2.0**-24)


class _Table:
    """How often choices were met, by rows of a table."""

    def __init__(self, rows: int, width: int):
        # A partition's tokens are far fewer than such a number holds.
        self.width, self.total, self.held, self.number = width, np.zeros(rows * width, np.int32), [], 0

    def add(self, rows: np.ndarray, choice: np.ndarray) -> None:
        self.held.append((rows.astype(np.int32) * np.int32(self.width) + choice[:, None].astype(np.int32)).ravel())
        self.number += rows.size
        if self.number > 1 << 20:
            self.settle()

    def settle(self) -> np.ndarray:
        """The counts in slabs of _ROWS rows."""
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=len(self.total)).astype(np.int32)
            self.held, self.number = [], 0
        return self.total.reshape(-1, _ROWS * self.width)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as the largest asks for, that number first; the lowest bytes of all come first, as upper ones compress well."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(x.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + np.ascontiguousarray(x, f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unpacked(data: np.ndarray) -> np.ndarray:
    width = int(data[0])
    return np.ascontiguousarray(data[1:].reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _tallied(lexicon: Lexicon, w: Weights, turn: int):
    """What a partition's tokens observe and draw, as whole numbers in slabs of rows, those without any left out.

    In turn 0 all weights are zero, so how often a row is met tells what it expects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Table(BUCKETS, lexicon.classes), _Table(INNER_BUCKETS, WIDE)
        other = (_Table(BUCKETS, lexicon.classes), _Table(INNER_BUCKETS, WIDE)) if turn else (_Table(BUCKETS, 1), _Table(INNER_BUCKETS, 1))
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                hashes, counts = token_hashes(block)
                rank = lexicon.index.find(hashes)
                all_keys, all_u = histories(hashes, counts), randoms(hashes, counts, turn)
                for a in range(0, len(rank), BATCH):
                    keys, u = all_keys[a : a + BATCH], all_u[:, a : a + BATCH]
                    cls, node, choice = lexicon.path(rank[a : a + BATCH])
                    rows = outer_rows(keys)
                    seen[0].add(rows, cls)
                    other[0].add(rows, drawn(exponentials(w.theta, rows, w.by_class)[0], u[-1]) if turn else np.zeros(len(rows), np.int32))
                    for j in range(DEEPEST):
                        own = np.flatnonzero(node[j] >= 0)
                        if len(own):
                            n = node[j, own]
                            rows = lexicon.inner_rows(keys[own], n)
                            seen[1].add(rows, choice[j, own])
                            other[1].add(rows, drawn(exponentials(w.phi, rows, w.in_node, n)[0], u[j, own]) if turn else np.zeros(len(rows), np.int32))
        for level in (0, 1):
            one, two = seen[level].settle(), other[level].settle()
            met = np.flatnonzero(one.any(axis=1))  # what is expected is so only where something was observed
            for k in range(0, len(met), _SLABS):
                some = met[k : k + _SLABS]
                slab = pa.array((some + level * (BUCKETS // _ROWS)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([slab, pa.array([_packed(np.concatenate([one[i], two[i]])) for i in some], pa.binary())], names=["slab", "sums"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the slabs of a partition as they stream by."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for slab, sums in zip(batch.column("slab").to_pylist(), batch.column("sums")):
            x = _unpacked(np.frombuffer(sums.as_buffer(), np.uint8))
            if slab in found:
                found[slab] += x
            else:
                found[slab] = x.copy()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([_packed(v) for v in found.values()], pa.binary())], names=["slab", "sums"])


def step(observed: np.ndarray, expected: np.ndarray, prior: np.ndarray | float, damped: float) -> np.ndarray:
    """The move of weights by iterative scaling: as the gradient, observed - expected, points."""
    return np.clip(np.log((observed + prior) / (expected + prior)) / damped, -LONGEST, LONGEST)


def _score(lexicon: Lexicon, w: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_count = np.append(np.log10(lexicon.count + 1.0), 0.0)
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                hashes, counts = token_hashes(block)
                rank = lexicon.index.find(hashes)
                all_keys = histories(hashes, counts)
                model = np.empty(len(rank))
                for a in range(0, len(rank), BATCH):
                    keys, r = all_keys[a : a + BATCH], rank[a : a + BATCH]
                    cls, node, choice = lexicon.path(r)
                    x, whole = exponentials(w.theta, outer_rows(keys), w.by_class)
                    p = x[np.arange(len(r)), cls] / whole
                    for j in range(DEEPEST):
                        own = np.flatnonzero(node[j] >= 0)
                        if len(own):
                            n = node[j, own]
                            x, whole = exponentials(w.phi, lexicon.inner_rows(keys[own], n), w.in_node, n)
                            p[own] *= x[np.arange(len(own)), choice[j, own]] / whole
                    out = np.log10(np.maximum(p.astype(np.float64), 1e-37))
                    out[r < 0] -= np.log10(lexicon.rest)
                    model[a : a + BATCH] = out
                base = log_count[rank] - np.log10(lexicon.whole)
                begin = np.cumsum(counts) - counts
                rare = rank < 0
                per = np.add.reduceat(rare.astype(np.int64), begin)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), pa.array(counts.astype(np.int64)), pa.array(np.add.reduceat((~rare).astype(np.int64), begin)),
                        pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(model, begin)), lists(hashes[rare].view(np.int64), per),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    return run


def _step() -> Column:
    return F.floor(F.log2("n") * 16)


def lexicon_of(texts: DataFrame) -> tuple[Lexicon, DataFrame]:
    """The lexicon of ``texts`` (text) and the written table (word hash, n) of the words it does not hold."""
    table = stored(texts.select("text").mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    # Steps of the logarithm of counts: a few hundred, whose sizes tell the least step of at most TOP words.
    sizes = table.groupBy(_step().alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    least, held = 1 << 30, 0
    for r in sizes:
        held += r["words"]
        if held > TOP:
            break
        least = r["step"]
    top = table.where(_step() >= least).toArrow()
    hashes, counts = top.column("word").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((hashes, -counts))
    hashes, counts = hashes[order], counts[order]
    lexicon = Lexicon(hashes.view(_U).copy(), counts.astype(np.int64).copy(), int(total["tokens"]), int(total["types"]))
    return lexicon, table.where(_step() < least)


def trained(texts: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS) -> Weights:
    """``texts`` (text): all rows teach in every round."""
    w = Weights.new(lexicon)
    shape = "slab int, sums binary"
    shares, owner = _shares(w.in_node.astype(np.float64)), lexicon.owner  # a row of the inner table belongs to one node
    for turn in range(rounds):
        tallies = texts.select("text").mapInArrow(_tallied(lexicon, w, turn), shape)
        # Sums of sums: many tasks share a slab's first sums, so none streams what all partitions gave.
        spread = tallies.withColumn("part", F.spark_partition_id() % 64).repartition("slab", "part").drop("part")
        sums = spread.mapInArrow(_summed, shape).repartition("slab").mapInArrow(_summed, shape).toArrow()
        outer = BUCKETS // _ROWS
        for slab, data in zip(sums.column("slab").to_pylist(), sums.column("sums")):
            x = _unpacked(np.frombuffer(data.as_buffer(), np.uint8)).astype(np.float64)
            table, at, width = (w.theta, slab, lexicon.classes) if slab < outer else (w.phi, slab - outer, WIDE)
            rows = slice(at * _ROWS, (at + 1) * _ROWS)
            seen, other = x[: _ROWS * width].reshape(_ROWS, width), x[_ROWS * width :].reshape(_ROWS, -1)
            if turn:
                table[rows] += step(seen, other, LATER, DAMPED if slab < outer else INNER_DAMPED)
            elif slab < outer:
                table[rows] += step(seen, other * _shares(w.by_class.astype(np.float64)), PRIOR * np.exp(w.by_class.astype(np.float64)), DAMPED)
            else:
                table[rows] += step(seen, other * shares[owner[rows]], INNER_PRIOR, INNER_DAMPED)
    return w


def scored(docs: DataFrame) -> DataFrame:
    """Base and model scores of every whole text of ``docs`` (doc_id, text).

    Learns from the rows with fold(7) other than 2.  Returns one row per input row: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score.  A null text is empty: one token, the end.  A
    null doc_id counts as an empty text in the fold.  Repeated rows are counted and scored each.
    """
    small_batches(docs.sparkSession)
    parts = fold("doc_id", 7)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (parts == 2).alias("held_out"))
    learn = rows.where(~F.col("held_out"))
    lexicon, table = lexicon_of(learn)
    weights = trained(learn, lexicon)
    made = rows.mapInArrow(
        _score(lexicon, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    ).withColumn("row", F.monotonically_increasing_id())
    made = stored(made, "lm-scores")
    # The words beyond TOP meet their counts in a join; none of them is frequent.
    rare = made.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    sums = (
        rare.join(table, "word")
        .groupBy("row")
        .agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("logs"))
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return made.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
