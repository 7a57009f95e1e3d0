"""Near-duplicate embeddings by NN-descent (operator 7).

Equal vectors of a label are one node with a number of copies.  A graph of each node's nearest
neighbours of its own label starts from a few orders by random hyperplanes, in which neighbouring rows
are compared, and is refined by joining the neighbours of neighbours until hardly an entry above the
threshold is new.  A list whose every entry passes the threshold is saturated; it is enlarged to all
saturated nodes of the label by products of blocks, which count links and give one representative of
each linked set.  Means and angles of blocks alone decide which pairs are too far apart for a link, and which
so close that all their vectors are linked, so that a large group of near copies is counted, not
multiplied; vectors move for the pairs between.  Recall is
audited against brute force on as many vectors as show ``LINKS`` links; below ``RECALL`` the lists are
doubled and refined again, and if that does not reach it either, blocks of all vectors give all links.
Links are decided in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .store import few, small_batches, stored

THRESHOLD, NEIGHBOURS, ORDERS, ROUNDS = 0.93, 16, 5, 8
CHUNK, BLOCK, SUPER = 256, 512, 256
#: The audit: vectors of its first slice and of all, true links that are enough to see, the recall it asks for; enlargements of all lists before blocks.
AUDIT, AUDITED, LINKS, RECALL, ENLARGEMENTS = 400, 12_000, 200, 0.98, 2
_NEAR = 1e-4  # float32 sums may be off by less


def _vectors(column: pa.Array, dims: int, kind=np.float32) -> np.ndarray:
    """Rows of a binary column of equal lengths, read from its buffer at once."""
    if not len(column):
        return np.zeros((0, dims), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, dims)


def _binary(rows: np.ndarray) -> pa.Array:
    """A matrix as a binary column, a row each."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _planes(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, 24)).astype(np.float32)


_POWERS = 1 << np.arange(23, -1, -1)


def _unit(dims: int):
    """Rows (node, label, copies, x: array<double>) -> unit vectors as bytes, in float32 and in double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            counts = np.diff(x.offsets.to_numpy())
            values = x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() : x.offsets[-1].as_py()]
            v = np.zeros((len(counts), dims))
            v[np.repeat(np.arange(len(counts)), counts), np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
            v /= np.maximum(np.abs(v).max(axis=1, keepdims=True), np.finfo(float).tiny)
            v /= np.sqrt(np.maximum((v * v).sum(axis=1, keepdims=True), np.finfo(float).tiny))
            own = [batch.column(c) for c in ("node", "label", "copies")]
            yield pa.RecordBatch.from_arrays([*own, _binary(v.astype(np.float32)), _binary(v)], names=["node", "label", "copies", "vec", "exact"])

    return run


def _coded(dims: int, seeds: list[int], names: list[str]):
    """Adds, for each seed, the signs of projections on 24 random hyperplanes as one number: a row for each."""
    planes = [_planes(dims, s) for s in seeds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column("vec"), dims)
            for t, p in enumerate(planes):
                code = (v @ p > 0) @ _POWERS
                turn = pa.array(np.full(len(v), t, np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), turn, pa.array(code.astype(np.int64))], names=[*names, "turn", "code"])

    return run


def _best(nodes: np.ndarray, labels: np.ndarray, v: np.ndarray, k: int, own: slice) -> pa.RecordBatch:
    """The ``k`` nearest of the rows ``own`` among all rows given."""
    s = v[own] @ v.T
    s[(labels[own, None] != labels[None, :]) | (nodes[own, None] == nodes[None, :])] = -2
    kk = min(k, len(nodes))
    at = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
    row = np.repeat(np.arange(len(s)), kk)
    sim = s[row, at.ravel()]
    ok = sim > -2
    return pa.RecordBatch.from_arrays([pa.array(nodes[own][row][ok]), pa.array(nodes[at.ravel()][ok]), pa.array(sim[ok].astype(np.float32))], names=["u", "v", "s"])


def _neighbouring(dims: int, k: int):
    """Sorted rows -> each row's nearest ones among those around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, labels, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims), np.float32)
        begin, edge = 0, CHUNK // 4  # the first row that has no list yet; rows that a row sees on each side at least
        for batch in batches:
            nodes = np.concatenate([nodes, batch.column("node").to_numpy()])
            labels = np.concatenate([labels, batch.column("label").to_numpy()])
            v = np.concatenate([v, _vectors(batch.column("vec"), dims)])
            while len(nodes) >= CHUNK:
                yield _best(nodes[:CHUNK], labels[:CHUNK], v[:CHUNK], k, slice(begin, CHUNK - edge))
                begin = edge
                nodes, labels, v = (x[CHUNK - 2 * edge :] for x in (nodes, labels, v))
        if begin < len(nodes):
            yield _best(nodes, labels, v, k, slice(begin, len(nodes)))

    return run


_EDGE = "u long, v long, s float"


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node by ``place``; ``fresh`` only where every mention is.  ``floor``: what a better one must pass."""
    each = edges.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    own = Window.partitionBy("u")
    placed = each.withColumn("place", F.row_number().over(own.orderBy(F.desc("s"), "v"))).where(F.col("place") <= k)
    return placed.withColumn("floor", F.when(F.count("*").over(own) >= k, F.min("s").over(own)).otherwise(F.lit(-2.0)).cast("float"))


def _local_join(dims: int):
    """Rows (w, members: list of (node, floor, fresh, vec)) -> pairs of members nearer than the further end's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            if not batch.num_rows:
                continue
            flat, limits = members.values, members.offsets.to_numpy()
            ids, floors = flat.field("node").to_numpy(), flat.field("floor").to_numpy()
            fresh = flat.field("fresh").to_numpy(zero_copy_only=False)
            v = _vectors(flat.field("vec"), dims)
            us, vs, ss = [], [], []
            for a, b in zip(limits[:-1], limits[1:]):
                if b - a < 2 or not fresh[a:b].any():
                    continue
                s = v[a:b] @ v[a:b].T
                ok = (s > floors[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]) & (ids[a:b, None] != ids[None, a:b])
                i, j = np.nonzero(ok)
                us.append(ids[a + i])
                vs.append(ids[a + j])
                ss.append(s[i, j])
            if us:
                u, w, s = np.concatenate(us), np.concatenate(vs), np.concatenate(ss)
                key = np.stack([u, w])
                order = np.lexsort(key)
                new = np.ones(len(order), bool)
                new[1:] = (key[:, order[1:]] != key[:, order[:-1]]).any(axis=0)
                at = order[new]
                yield pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(w[at]), pa.array(s[at].astype(np.float32))], names=["u", "v", "s"])

    return run


def _descend(graph: DataFrame, vectors: DataFrame, dims: int, k: int, size: int, near: float) -> DataFrame:
    """Refine the lists until fewer than one in two hundred of the entries of at least ``near`` is new."""
    for step in range(ROUNDS):
        floors = graph.where("place = 1").select(F.col("u").alias("node"), "floor")
        known = vectors.select("node", "vec").join(floors, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0).cast("float")))
        # Of a list's reverse entries a hash of the round takes as many as the list holds.
        order = Window.partitionBy("w").orderBy(F.desc("fresh"), F.xxhash64("node", F.lit(step)))
        back = graph.select(F.col("v").alias("w"), F.col("u").alias("node"), "fresh")
        back = back.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k).drop("turn")
        members = graph.select(F.col("u").alias("w"), F.col("v").alias("node"), "fresh").union(back).join(known, "node")
        groups = members.groupBy("w").agg(F.collect_list(F.struct("node", "floor", "fresh", "vec")).alias("members"))
        better = few(groups, size // k, 500).mapInArrow(_local_join(dims), _EDGE).withColumn("fresh", F.lit(True))
        old = graph.select("u", "v", "s", F.lit(False).alias("fresh"))
        graph = stored(_nearest(old.union(better), k), "descent", size)
        sizes = graph.where(F.col("s") >= near).agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")).first()
        if sizes["fresh"] * 200 <= sizes["n"]:
            break
    return graph


def _blocks(dims: int):
    """Rows sorted by (label, component) -> blocks of one component with their mean direction and the widest angle from it."""

    def give(label, nodes, copies, v):
        mean = v.mean(axis=0)
        mean /= max(np.sqrt((mean * mean).sum()), 1e-300)
        angle = float(np.arccos(np.clip(v @ mean, -1, 1)).max())
        cells = [[label], [int(nodes[0])], [nodes.tobytes()], [copies.tobytes()], [v.tobytes()], [mean.tobytes()], [angle], [int(copies.sum())], [int(nodes.min())]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["label", "block", "nodes", "copies", "vectors", "mean", "angle", "weight", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [*(batch.column(c).to_numpy() for c in ("label", "component", "node", "copies")), _vectors(batch.column("exact"), dims, np.float64)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            ends = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            a = 0
            for b in [*ends.tolist(), len(held[0])]:
                while b - a >= BLOCK or (b < len(held[0]) and b > a):
                    c = min(b, a + BLOCK)
                    yield give(int(held[0][a]), held[2][a:c], held[3][a:c], held[4][a:c])
                    a = c
            held = [x[a:] for x in held]
        if held is not None and len(held[0]):
            yield give(int(held[0][0]), held[2], held[3], held[4])

    return run


_SUMMARY = ("blocks", "means", "angles", "weights", "leasts")


def _supers(dims: int):
    """Rows (label, block, mean, angle, weight, least), labels together -> up to ``SUPER`` of one label in a row."""

    def give(label, *parts):
        cells = [[label], [int(parts[0][0])], *([p.tobytes()] for p in parts)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["label", "super", *_SUMMARY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, block, angle, weight, least = (batch.column(c).to_numpy() for c in ("label", "block", "angle", "weight", "least"))
            own = (block, _vectors(batch.column("mean"), dims, np.float64), angle, weight, least)
            ends = np.flatnonzero(label[1:] != label[:-1]) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(label)]):
                for c in range(a, b, SUPER):
                    yield give(int(label[c]), *(x[c : min(b, c + SUPER)] for x in own))

    return run


def _near_blocks(dims: int, threshold: float):
    """Pairs of such rows -> rows (block, other, weight, least, own).

    With ``other``: blocks that may hold a link, each pair once.  Without: the weight and the smallest node
    of the blocks whose vectors are all linked with the block's, and whether it itself is one (``own``).
    """
    widest, slack = float(np.arccos(threshold)), 1e-6
    names = ["block", "other", "weight", "least", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
                (a, x, ra, wa, la), (b, y, rb, wb, lb) = (
                    (cell(f"{o}blocks", np.int64), cell(f"{o}means", np.float64).reshape(-1, dims), cell(f"{o}angles", np.float64), cell(f"{o}weights", np.int64), cell(f"{o}leasts", np.int64))
                    for o in ("", "other_")
                )
                between, reach = np.arccos(np.clip(x @ y.T, -1, 1)), ra[:, None] + rb[None, :]
                self_ = a[0] == b[0]
                between[a[:, None] == b[None, :]] = 0.0
                all_ = between + reach <= widest - slack
                some = (between - reach <= widest + slack) & ~all_
                i, j = np.nonzero(some & (a[:, None] <= b[None, :]) if self_ else some)
                yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j]), *(pa.nulls(len(i), pa.int64()) for _ in range(3))], names=names)
                for one, linked, weight, least in ((a, all_, wb, lb),) if self_ else ((a, all_, wb, lb), (b, all_.T, wa, la)):
                    at = np.flatnonzero(linked.any(axis=1))
                    sums, low = linked[at] @ weight, np.where(linked[at], least[None, :], np.iinfo(np.int64).max).min(axis=1)
                    own = np.diagonal(linked)[at].astype(np.int64) if self_ else np.zeros(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(one[at]), pa.nulls(len(at), pa.int64()), pa.array(sums), pa.array(low), pa.array(own)], names=names)

    return run


def _all_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the sums of the blocks that are all linked with them -> (node, links, smallest node)."""
    for batch in batches:
        for k in range(batch.num_rows):
            nodes, copies = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in ("nodes", "copies"))
            n = batch.column("weight")[k].as_py() - batch.column("own")[k].as_py() * copies
            ok = n > 0
            top = np.minimum(nodes, batch.column("least")[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(nodes[ok]), pa.array(n[ok]), pa.array(top[ok])], names=["node", "n", "top"])


def _block_links(dims: int, threshold: float):
    """Pairs of blocks -> (node, links in the other block, the smallest node that these links reach)."""
    big = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
                a, b, m, n = (cell(c, np.int64) for c in ("nodes", "other_nodes", "copies", "other_copies"))
                x, y = (cell(c, np.float64).reshape(-1, dims) for c in ("vectors", "other_vectors"))
                linked = x @ y.T >= threshold
                if a[0] == b[0]:
                    np.fill_diagonal(linked, False)
                one, two = a.copy(), b.copy()
                while True:
                    new_two = np.minimum(two, np.where(linked, one[:, None], big).min(axis=0))
                    new_one = np.minimum(one, np.where(linked, new_two[None, :], big).min(axis=1))
                    if np.array_equal(new_one, one) and np.array_equal(new_two, two):
                        break
                    one, two = new_one, new_two
                rows = [(a, linked @ n, one)] if a[0] == b[0] else [(a, linked @ n, one), (b, m @ linked, two)]
                node, links, top = (np.concatenate([r[c] for r in rows]) for c in range(3))
                ok = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(links[ok].astype(np.int64)), pa.array(top[ok])], names=["node", "n", "top"])

    return run


def _dense(packed: DataFrame, dims: int, threshold: float, size: int) -> DataFrame:
    """(node, n, top) of the links among ``packed`` (label, component, node, copies, exact), sorted by (label, component)."""
    shape = "label long, block long, nodes binary, copies binary, vectors binary, mean binary, angle double, weight long, least long"
    blocks = stored(few(packed.select("label", "component", "node", "copies", "exact"), size, 8192).mapInArrow(_blocks(dims), shape), "descent-blocks")
    shape = "label long, super long, blocks binary, means binary, angles binary, weights binary, leasts binary"
    supers = stored(blocks.select("label", "block", "mean", "angle", "weight", "least").mapInArrow(_supers(dims), shape), "descent-supers", size)
    # Which pairs are near is known from numbers and means alone; vectors are fetched for those.
    slim = supers.select("label", "super")
    listed = slim.join(slim.select("label", F.col("super").alias("other_super")), "label").where(F.col("super") <= F.col("other_super")).drop("label")
    means = listed.join(supers.drop("label"), "super").join(_other(supers.drop("label")), "other_super")
    shape = "block long, other long, weight long, least long, own long"
    near = stored(few(means.drop("super", "other_super"), size, 8192).mapInArrow(_near_blocks(dims, threshold), shape), "descent-near")
    own = blocks.select("block", "nodes", "copies", "vectors")
    pairs = near.where("other is not null").select("block", "other").join(own, "block").join(_other(own).withColumnRenamed("other_block", "other"), "other").drop("block", "other")
    sums = near.where("other is null").groupBy("block").agg(F.sum("weight").alias("weight"), F.min("least").alias("least"), F.sum("own").alias("own"))
    whole = own.drop("vectors").join(sums, "block").drop("block")
    shape = "node long, n long, top long"
    dense = few(pairs, size, 4000).mapInArrow(_block_links(dims, threshold), shape).union(few(whole, size).mapInArrow(_all_linked, shape))
    return stored(dense, "descent-dense")


def _other(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"other_{c}") for c in rows.columns))


def _double(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_vectors(batch.column(c), dims, np.float64) if batch.num_rows else np.zeros((0, dims)) for c in ("ea", "eb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x * y).sum(axis=1))], names=["a", "b", "cosine"])

    return run


def _audited(vectors: DataFrame, size: int, links: DataFrame, full: DataFrame, dims: int, threshold: float) -> float:
    """The share of the links of some unsaturated vectors, by brute force, that ``links`` holds.

    Slices of growing size, each up to a bound that the driver holds, go on until ``LINKS`` true links are
    seen or ``AUDITED`` vectors, so there are at most six jobs however many vectors there are.  Where links
    are so rare that the vectors end it and none of their links is missed, fewer than one vector in 4,000
    misses one, with a certainty of 95 in 100 (three by the number seen).
    """
    place = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1 << 20))
    each = (1 << 20) / max(size, 1)
    low, width, audited, n, hits = 0, AUDIT, 0, 0, 0
    while n < LINKS and low < 1 << 20 and audited < AUDITED:
        high, audited = low + max(1, round(width * each)), audited + width
        seen = _slice_links(vectors, vectors.where((place >= low) & (place < high)).join(full, "node", "left_anti"), dims, threshold)
        if seen is not None:
            got = seen.join(links.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
            n, hits = n + got["n"], hits + got["hits"]
        low, width = high, min(4 * width, 3200)
    return 1.0 if not n else hits / n


def _slice_links(vectors: DataFrame, some: DataFrame, dims: int, threshold: float) -> DataFrame | None:
    """All links of the vectors ``some``, by brute force; those between two of them twice."""
    some = some.select("node", "label", "exact").toArrow()
    if not some.num_rows:
        return None
    ids, labels = some.column("node").to_numpy(), some.column("label").to_numpy()
    v = _vectors(some.column("exact").combine_chunks(), dims, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = v @ _vectors(batch.column("exact"), dims, np.float64).T
            own, other = batch.column("node").to_numpy(), batch.column("label").to_numpy()
            i, j = np.nonzero((s >= threshold) & (labels[:, None] == other[None, :]) & (ids[:, None] != own[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], own[j])), pa.array(np.maximum(ids[i], own[j]))], names=["a", "b"])

    return vectors.select("node", "label", "exact").mapInArrow(run, "a long, b long")


def _links(graph: DataFrame, vectors: DataFrame, dims: int, threshold: float, size: int) -> DataFrame:
    """(a, b), a < b: the entries of the lists that are links; those near the threshold are decided in doubles."""
    close = graph.where(F.col("s") >= threshold - _NEAR).groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max("s").alias("s"))
    close = stored(close, "descent-pairs", size)
    exact = vectors.select("node", "exact")
    both = close.where(F.col("s") < threshold + _NEAR).select("a", "b").join(exact.select(F.col("node").alias("a"), F.col("exact").alias("ea")), "a")
    both = both.join(exact.select(F.col("node").alias("b"), F.col("exact").alias("eb")), "b")
    decided = few(both, size).mapInArrow(_double(dims), "a long, b long, cosine double").where(F.col("cosine") >= threshold).select("a", "b")
    return stored(close.where(F.col("s") >= threshold + _NEAR).select("a", "b").union(decided), "descent-links", size)


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """Links of cosine >= ``threshold`` between vectors of equal label, and their components.

    ``rows`` (vec_id, embedding, label).  Returns one row per input row: vec_id, n_links, component_id,
    kept.  Vectors that are null, zero or hold null or non-finite components, and rows without a label or
    an id, link with nothing and are their own component (null for a null id).  Shorter vectors count as
    ending in zeros.  Rows that repeat an id are vectors each.
    """
    small_batches(rows.sparkSession)
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    usable = usable & F.coalesce(F.exists(x, lambda c: c != 0), F.lit(False))
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(F.col("label").cast("string")).alias("label"), F.when(usable, x).alias("x"))
    ids = ids.select("*", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(7), "x").alias("k2"), F.monotonically_increasing_id().alias("row"))
    ids = stored(ids, "descent-rows")
    sizes = ids.agg(F.max(F.size("x")).alias("dims"), F.count("x").alias("n")).first()
    dims, n = sizes["dims"] or 0, sizes["n"]
    if not n:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    key = ["label", "k1", "k2"]
    used = ids.where("x is not null")
    nodes = stored(used.groupBy(*key).agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "descent-nodes", n)
    firsts = ids.select(F.col("row").alias("node"), "x").join(nodes.select("node", "label", "copies"), "node")
    vectors = few(firsts.select("node", "label", "copies", "x"), n, 4000).mapInArrow(_unit(dims), "node long, label long, copies long, vec binary, exact binary")
    vectors = stored(vectors, "descent-vectors")
    near = threshold - _NEAR
    graph = None
    for enlargement in range(ENLARGEMENTS + 1):
        seeds = [100 * enlargement + t for t in range(ORDERS)]
        coded = vectors.select("node", "label", "vec").mapInArrow(_coded(dims, seeds, ["node", "label", "vec"]), "node long, label long, vec binary, turn int, code long")
        order = ["turn", "label", "code", "node"]
        ordered = coded.repartitionByRange(max(1, n * ORDERS // 16384), *order).sortWithinPartitions(*order)
        found = few(ordered.select("node", "label", "vec"), n * ORDERS, 8192).mapInArrow(_neighbouring(dims, k), _EDGE).withColumn("fresh", F.lit(True))
        if graph is not None:
            found = graph.select("u", "v", "s", "fresh").union(found)
        graph = _descend(stored(_nearest(found, k), "descent", n * k), vectors, dims, k, n * k, near)
        full = stored(graph.where((F.col("place") == k) & (F.col("s") >= near)).select(F.col("u").alias("node")), "descent-full", n)
        links = _links(graph, vectors, dims, threshold, n)
        enough = _audited(vectors, n, links, full, dims, threshold) >= RECALL
        if enough:
            break
        k *= 2
    # Saturated vectors: all their links with each other, by blocks; with others, by the others' lists.
    order = ["label", "component", "node"]
    if not enough:
        # Lists that miss links even so decide nothing: all vectors count as saturated, in blocks by direction.
        full = vectors.select("node")
        names = ["node", "label", "copies", "exact"]
        coded = vectors.mapInArrow(_coded(dims, [0], names), "node long, label long, copies long, exact binary, turn int, code long")
        packed = coded.select(*names, F.lit(0).cast("long").alias("component"), "code")
        order.insert(2, "code")
    else:
        inner = links.join(full.withColumnRenamed("node", "a"), "a", "left_semi").join(full.withColumnRenamed("node", "b"), "b", "left_semi")
        groups = components(inner, "descent-groups", n)
        packed = vectors.join(full, "node", "left_semi").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    packed = packed.repartitionByRange(max(1, n // 8192), *order).sortWithinPartitions(*order)
    dense = _dense(packed, dims, threshold, n)
    outer = _outer(links, full)
    several = nodes.where("copies > 1").select(F.col("node").alias("other"), "copies")
    ends = outer.select(F.col("a").alias("node"), F.col("b").alias("other")).union(outer.select("b", "a")).join(several, "other", "left")
    ends = ends.select("node", F.coalesce("copies", F.lit(1)).alias("n")).union(dense.select("node", "n"))
    counts = ends.groupBy("node").agg(F.sum("n").alias("n"))
    reached = components(outer.union(dense.where("node <> top").select("node", "top")), "descent-all", n)
    named = nodes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    named = stored(named.select(*key, "component", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "descent-named", n)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").select(*key, "n_links", "component_id")
    out = used.select("vec_id", *key).join(known, key).select("vec_id", "n_links", "component_id")
    rest = ids.where("x is null").select("vec_id", F.lit(0).cast("long"), "vec_id")
    component = F.col("component_id")
    return few(out, n).union(rest).select("vec_id", "n_links", component, F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _outer(links: DataFrame, full: DataFrame) -> DataFrame:
    """The links with an end that is not saturated."""
    marked = links.join(full.select(F.col("node").alias("a"), F.lit(1).alias("fa")), "a", "left").join(full.select(F.col("node").alias("b"), F.lit(1).alias("fb")), "b", "left")
    return marked.where("fa is null or fb is null").select("a", "b")
