"""Line dedup by a log-template tree (operator 2).

A line falls through a tree of fixed depth: its number of tokens, then its first ``depth`` tokens.
Tokens with a digit are variable fields.  In a leaf, a token is constant if it stands at its place in
lines of at least ``min_docs`` documents; the others are variable, and a line's template is what is
left.  A template is dropped if at least ``min_docs`` documents hold it, at least ``share`` of its places
are constant and one of these is no variable field, so that bare numbers are no template; the document
of the smallest id keeps its lines, so no content is lost whole.  Lines of any length take part.
The rules look at counts alone, so no leaf is ever gathered: all is hash aggregates and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import named as renamed
from .store import nameless, small_batches, stored
from .textblocks import Block, _powers, blocks, lists, mix, mix_int, span_hashes, words

MIN_DOCS, SHARE, DEPTH = 10, 0.7, 3
_U = np.uint64
_FIELD = _U(mix_int(0x3C2A3E))
_FIELD_LONG = int(_FIELD.view(np.int64))
_LAST_ID = 2**63 - 1
_NAME = ["doc", "k1", "k2"]


def _parsed(block: Block, depth: int):
    """(text, line number, tokens, leaf, first token's number) of each line with a token; masked token hashes."""
    w = words(block)
    h = span_hashes(block.data, w.start, w.end)
    digits = np.concatenate([[0], np.cumsum((block.data >= 48) & (block.data <= 57))])
    h = np.where(digits[w.end] > digits[w.start], _FIELD, h)
    breaks = np.concatenate([[0], np.cumsum(block.data == 10)])
    line = breaks[w.start] - breaks[block.bounds[w.doc]]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (w.doc[1:] != w.doc[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(h))
    leaf = n.astype(_U) * _U(mix_int(99) | 1)
    for k in range(depth):
        if len(first):
            leaf += np.where(n > k, h[np.minimum(first + k, len(h) - 1)], _U(0)) * _U(mix_int(100 + k) | 1)
    return w.doc[first], line[first], n, mix(leaf), first, h


def _once(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1 at the first mention of a value in its text, else 0."""
    order = np.lexsort((np.arange(len(doc)), value, doc))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (value[order][1:] != value[order][:-1])
    out = np.zeros(len(doc), dtype=np.int64)
    out[order[new]] = 1
    return out


def _leaves(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.select(_NAME)
            for block in blocks(batch.column("text")):
                doc, line, _, leaf, _, _ = _parsed(block, depth)
                part = names.take(pa.array(block.first + doc))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(line.astype(np.int32)), pa.array(leaf.view(np.int64)), pa.array(_once(doc, leaf))], names=[*_NAME, "line", "leaf", "once"]
                )

    return run


def _tokens(depth: int):
    """Texts with the numbers of some of their lines -> these lines' leaves, hashes and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, wanted = batch.select(_NAME), batch.column("lines")
            limits, values = wanted.offsets.to_numpy(), wanted.values.to_numpy()
            for block in blocks(batch.column("text")):
                doc, line, n, leaf, first, h = _parsed(block, depth)
                at = block.first + np.arange(block.rows)
                own = np.repeat(np.arange(block.rows), limits[at + 1] - limits[at]) << 32 | values[limits[block.first] : limits[block.first + block.rows]].astype(np.int64)
                keep = np.isin(doc << 32 | line, own)
                doc, line, n, leaf, first = doc[keep], line[keep], n[keep], leaf[keep], first[keep]
                if not len(doc):
                    continue
                power, back = _powers(1 << max(12, len(h).bit_length()))
                sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h) * power[: len(h)])])
                whole = mix((sums[first + n] - sums[first]) * back[first] + n.astype(_U))
                flat = h[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                part = names.take(pa.array(block.first + doc))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(line.astype(np.int32)), pa.array(leaf.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(_once(doc, whole)), lists(flat.view(np.int64), n)],
                    names=[*_NAME, "line", "leaf", "content", "once", "tokens"],
                )

    return run


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, depth: int = DEPTH) -> DataFrame:
    """(doc, k1, k2, lines): the numbers of the lines to drop of each document that has any.

    ``docs``: (doc, k1, k2, text), as ``named`` gives them.
    """
    docs = docs.select(*_NAME, "text")
    name = ", ".join(f"{c} long" for c in _NAME)
    lines = stored(docs.mapInArrow(_leaves(depth), f"{name}, line int, leaf long, once long"), "template-lines")
    busy = lines.groupBy("leaf").agg(F.sum("once").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    wanted = lines.join(busy, "leaf").groupBy(*_NAME).agg(F.collect_list("line").alias("lines"))
    found = docs.join(wanted, _NAME).select(*_NAME, "lines", "text").mapInArrow(
        _tokens(depth), f"{name}, line int, leaf long, content long, once long, tokens array<long>"
    )
    found = stored(found, "template-tokens")
    contents = stored(found.groupBy("leaf", "content").agg(F.sum("once").alias("n"), F.first("tokens").alias("tokens")), "template-contents")
    places = contents.select("leaf", "content", "n", F.posexplode("tokens").alias("place", "token"))
    constant = places.groupBy("leaf", "place", "token").agg(F.sum("n").alias("held")).where(F.col("held") >= min_docs)
    fixed = places.join(constant, ["leaf", "place", "token"]).groupBy("leaf", "content").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("fixed"))
    named = contents.join(fixed, ["leaf", "content"]).where((F.size("fixed") >= F.size("tokens") * share) & F.exists("fixed", lambda p: p["token"] != _FIELD_LONG))
    # Written before the join, so that a frequent line's side can be split.
    named = stored(named.select("leaf", "content", F.xxhash64("leaf", "fixed").alias("template")), "template-named")
    held = stored(found.select(*_NAME, "line", "leaf", "content").join(named, ["leaf", "content"]).select(*_NAME, "line", "template"), "template-held")
    counts = held.groupBy("template", *_NAME).agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("n"), F.min("doc").alias("keeper"))
    counts = counts.where(F.col("n") >= min_docs)
    return held.join(counts, "template").where(F.col("doc") != F.col("keeper")).groupBy(*_NAME).agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the lines of recurring templates dropped from ``text``.

    Adds n_lines and n_dropped.  A null text stays null and has no lines; an empty one has one empty line.
    Lines of white space alone stay.  Rows without an id count as documents and keep a template's lines
    only if no row with an id holds it.  Rows that repeat an id and text are one document of a template,
    though each counts where constant tokens are looked for.  Other columns stay as they are; columns with the added names are replaced.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("doc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]
    drop = recurring_lines(docs.select(*keys, text.alias("text")), **limits)
    plain, names = nameless(docs, ("n_lines", "n_dropped"))
    own = f"r.c{names.index('text')}"
    # The rows under names of their own, beside the keys that the drops are found by.
    at = {c: F.col(f"c{names.index(c)}") for c in ("doc_id", "text")}
    content = F.coalesce(at["text"].cast("string"), F.lit(""))
    one = plain.select(F.struct("*").alias("r"), F.coalesce(at["doc_id"].cast("long"), F.lit(_LAST_ID)).alias("doc"), F.xxhash64(content).alias("k1"), F.xxhash64(F.lit(7), content).alias("k2"))
    rows = one.alias("d").join(drop.alias("x"), _NAME, "left").select("r", "lines")
    rows = rows.withColumn("parts", F.split(F.col(own), "\n"))
    # A hash set of the lines to drop: long texts may lose tens of thousands.
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "lines")
    kept = F.transform(left, lambda i: F.get("parts", i))
    new = F.when(F.col("lines").isNull(), F.col(own)).otherwise(F.array_join(kept, "\n"))
    parts = F.col("parts")
    out = rows.select(
        *(new.alias(c) if n == "text" else F.col(f"r.{c}") for c, n in zip(plain.columns, names)),
        F.greatest(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return renamed(out, [*names, "n_lines", "n_dropped"])
