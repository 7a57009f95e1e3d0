"""Exact top-k inner products by norm-sorted blocks and SVD-rotated partial sums (operator 5).

Candidates are sorted by descending length and packed into blocks, neighbouring blocks into bands.  A
rotation by the singular vectors of all candidates (from their Gram matrix, summed in the cluster) puts
most of each inner product into the first coordinates.  Bands are read in waves, the longest vectors
first; after each wave a query's floor is its k-th best score so far.  A band is read for a block of
queries only if the longest query times the band's longest vector reaches the least floor: numbers
decide this before any vector moves.  Inside, a candidate's exact integer product is taken only if its
rotated partial sum plus the product of the two residual lengths (Cauchy-Schwarz) reaches the floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import few, small_batches, stored

K, LEVELS, EVERY = 20, 64, 20
BLOCK, HEAD_DIMS = 4096, 16
#: Bands of a wave by those before it.
GROWTH = 8


def integer_vectors(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(vec_id, v: array<double> of whole numbers) of the rows whose id and whose components are all usable."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, _finite), F.lit(False))
    # Spark's floor() of a double is a long and stops at its ends, so large numbers are kept: they are whole.
    floor = lambda c: F.when(F.abs(c * levels) < 2.0**52, F.floor(c * levels).cast("double")).otherwise(c * levels)
    return rows.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, floor).alias("v"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors end in zeros."""
    counts = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out = np.zeros((len(counts), dims))
    out[np.repeat(np.arange(len(counts)), counts), np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
    return out


def _grams(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            total += x.T @ x
        at = np.arange(dims)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total))], names=["i", "g"])

    return run


def _packed(dims: int, size: int, kind: str):
    """Sorted rows -> blocks: row numbers, ids and components as bytes, so that a pair of blocks is one row."""

    def give(parts: list[tuple]) -> pa.RecordBatch:
        rows, ids, x = (np.concatenate(p) for p in zip(*parts))
        length = float(np.sqrt((x * x).sum(axis=1)).max())
        cells = [[int(rows[0])], [rows.tobytes()], [ids.tobytes()], [x.astype(kind).tobytes()], [length]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["block", "rows", "ids", "vectors", "longest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            own = (batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dims))
            a, n = 0, len(own[0])
            while a < n:
                b = min(n, a + size - held)
                parts.append(tuple(x[a:b] for x in own))
                held += b - a
                a = b
                if held == size:
                    yield give(parts)
                    parts, held = [], 0
        if held:
            yield give(parts)

    return run


_BLOCK = "block long, rows binary, ids binary, vectors binary, longest double"


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles do where no sum can pass 2 ** 53."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0**53:
        return np.rint(q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return np.einsum("qd,cd->qc", q.astype(np.int64), c.astype(np.int64))


def block_best(q_rows, q, floors, c_rows, c_ids, c, rotation: np.ndarray, head: int, k: int):
    """(query numbers, candidate ids, scores) of each query's ``k`` best in a block that reach its floor."""
    qr, cr = q.astype(np.float64) @ rotation, c.astype(np.float64) @ rotation
    q_rest, c_rest = np.sqrt((qr[:, head:] ** 2).sum(axis=1)), np.sqrt((cr[:, head:] ** 2).sum(axis=1))
    bound = qr[:, :head] @ cr[:, :head].T + q_rest[:, None] * c_rest[None, :]
    slack = 1e-9 * (1 + np.sqrt((qr**2).sum(axis=1))[:, None] * np.sqrt((cr**2).sum(axis=1)).max(initial=0))
    open_ = (bound + slack >= floors[:, None]) & (q_rows[:, None] != c_rows[None, :])
    rows, columns, scores = [], [], []
    used = np.flatnonzero(open_.any(axis=0))
    exact = products(q, c[used])
    for i in range(len(q)):
        at = np.flatnonzero(open_[i, used])
        s = exact[i, at]
        at, s = at[s >= floors[i]], s[s >= floors[i]]
        if len(at) > k:
            low = np.partition(s, len(s) - k)[len(s) - k]
            at, s = at[s >= low], s[s >= low]
        ids = c_ids[used[at]]
        best = np.lexsort((c_rows[used[at]], ids, -s))[:k]
        rows.append(np.full(len(best), i))
        columns.append(ids[best])
        scores.append(s[best])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(scores)


def _compare(dims: int, rotation: np.ndarray, head: int, k: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                cell = lambda name, kind: np.frombuffer(batch.column(name)[j].as_buffer(), kind)
                q_rows, q_ids, rows, ids = (cell(n, np.int64) for n in ("q_rows", "q_ids", "rows", "ids"))
                q, c = (cell(n, kind).reshape(-1, dims).astype(np.int64) for n in ("q_vectors", "vectors"))
                floors, longest = cell("floors", np.float64), batch.column("longest")[j].as_py()
                own = np.flatnonzero(np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * longest * (1 + 1e-9) >= floors)
                if len(own):
                    at, found, scores = block_best(q_rows[own], q[own], floors[own], rows, ids, c, rotation, head, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_rows[own][at]), pa.array(q_ids[own][at]), pa.array(found), pa.array(scores)], names=["query", "query_id", "vec_id", "score"])

    return run


_FOUND = "query long, query_id long, vec_id long, score long"


def open_pairs(queries: DataFrame, blocks: DataFrame, low: int, high: int) -> DataFrame:
    """(q_block, block) of the pairs with a band from ``low`` until before ``high`` that may hold a score.

    ``queries`` (q_block, q_longest, least: the smallest floor), ``blocks`` (band, block, longest): numbers only.
    """
    listed = queries.withColumn("band", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
    reach = F.col("q_longest") * F.col("longest") * (1 + 1e-9) >= F.col("least")
    return listed.join(blocks, "band").where(reach).select("q_block", "block")


def top_inner_products(rows: DataFrame, is_query: Column | None = None, k: int = K, levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """The ``k`` largest integer inner products of each query with all other rows.

    ``rows`` (vec_id, embedding).  Queries: ids divisible by ``EVERY`` unless ``is_query`` says otherwise.
    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.  Vectors that are null
    or hold null or non-finite components, and rows without an id, take no part; shorter vectors count as
    ending in zeros.  Rows that repeat an id are queries and candidates each: only a query's own row is
    none of its candidates.  Components so large that a product could pass a long raise ValueError.
    """
    spark = rows.sparkSession
    small_batches(spark)
    is_query = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    vectors = stored(integer_vectors(rows, levels).withColumn("is_query", is_query).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    largest = F.array_max(F.transform("v", F.abs))
    sizes = vectors.agg(F.max(F.size("v")).alias("dims"), F.count("*").alias("n"), F.count_if("is_query").alias("queries"), F.max(largest).alias("largest")).first()
    if not sizes["n"] or not sizes["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, dims, most = sizes["n"], max(1, sizes["dims"]), sizes["largest"] or 0.0
    if most * most * dims >= 2.0**63:
        raise ValueError(f"inner products of components up to {most:g} do not fit a long")
    kind = next(t for t in ("int16", "int32", "int64") if most <= np.iinfo(t).max)
    parts = few(vectors.select("v"), n).mapInArrow(_grams(dims), "i long, g array<double>")
    sums = parts.select("i", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros((dims, dims))
    gram[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["x"].to_numpy()
    rotation, head = np.linalg.eigh(gram)[1][:, ::-1].copy(), min(HEAD_DIMS, dims)
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    places = max(1, -(-n // (4 * block)))
    ordered = vectors.withColumn("len", length).repartitionByRange(places, F.desc("len"), "row").sortWithinPartitions(F.desc("len"), "row")
    # A band is what one range of lengths holds: a few blocks.  Bands are numbered by falling length.
    ordered = few(ordered.select("row", "vec_id", "v"), n, 4 * block)
    candidates = stored(ordered.mapInArrow(_packed(dims, block, kind), _BLOCK).withColumn("band", F.spark_partition_id()), "topk-blocks")
    slim = candidates.select("band", "block", "longest")
    bands = slim.agg(F.max("band")).first()[0] + 1
    queries = few(vectors.where("is_query").select("row", "vec_id", "v"), sizes["queries"], block // 2).mapInArrow(_packed(dims, max(1, block // 8), kind), _BLOCK)
    queries = queries.select(*(F.col(c).alias(f"q_{c}") for c in ("block", "rows", "ids", "vectors", "longest")))
    queries = stored(queries, "topk-queries")
    compare = _compare(dims, rotation, head, k, kind)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits, low, high = None, 0, 1
    while low < bands:
        armed = few(queries if hits is None else queries.join(_by_block(queries, hits, k), "q_block", "left"), sizes["queries"], block)
        armed = armed if hits is not None else armed.withColumn("f", F.lit(None).cast("map<bigint,bigint>"))
        armed = stored(armed.mapInArrow(_armed, _ARMED), "topk-armed")
        pairs = open_pairs(armed.select("q_block", "q_longest", "least"), slim, low, high)
        fetched = pairs.join(armed.drop("q_longest", "least"), "q_block").join(candidates.drop("band"), "block").drop("block", "q_block")
        # A row is a pair of blocks; hashes of both spread the pairs of a hot block.
        found = fetched.repartition(F.xxhash64("q_rows", "rows")).mapInArrow(compare, _FOUND)
        found = found if hits is None else hits.union(found)
        hits = stored(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "topk-hits", sizes["queries"] * k).drop("rank")
        low, high = high, min(bands, GROWTH * high)
    return hits.withColumn("rank", F.row_number().over(best).cast("int")).select("query_id", "rank", "vec_id", "score")


def _by_block(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(q_block, f): the floors of a block's queries that have ``k`` scores, by row."""
    floors = hits.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    rows = queries.select("q_block", "q_rows").mapInArrow(_rows, "q_block long, query long")
    return rows.join(floors, "query").groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("query", "floor"))).alias("f"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, rows in zip(batch.column("q_block").to_pylist(), batch.column("q_rows")):
            own = np.frombuffer(rows.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], names=["q_block", "query"])


_ARMED = "q_block long, q_rows binary, q_ids binary, q_vectors binary, q_longest double, floors binary, least double"


def _armed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries with their floors (none: minus infinity) and the least of them."""
    for batch in batches:
        floors = []
        for rows, known in zip(batch.column("q_rows"), batch.column("f").to_pylist()):
            known = dict(known or [])
            floors.append(np.array([known.get(r, -np.inf) for r in np.frombuffer(rows.as_buffer(), np.int64).tolist()], np.float64))
        own = [batch.column(c) for c in ("q_block", "q_rows", "q_ids", "q_vectors", "q_longest")]
        made = [pa.array([f.tobytes() for f in floors], pa.binary()), pa.array([float(f.min()) for f in floors], pa.float64())]
        yield pa.RecordBatch.from_arrays([*own, *made], names=["q_block", "q_rows", "q_ids", "q_vectors", "q_longest", "floors", "least"])
