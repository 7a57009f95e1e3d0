"""Connected components by contracting links, as joins and aggregates over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def components(edges: DataFrame, tag: str = "cc", rows: int | None = None) -> DataFrame:
    """``edges`` (a, b), longs, not null -> (node, component): the smallest node that links reach.

    In each round every node points at the neighbour whose hash of that round is smallest.  Such pointers
    form trees whose roots are pairs that point at each other; the smaller one of a pair is the root.
    Pointers are followed for four steps, as deep as trees by random orders usually are, and the ends of
    links are replaced by where they lead.  Every tree holds two nodes or more, so nodes at least halve
    in a round whatever the order of their numbers is: rounds grow with the logarithm of the size.
    Only numbers of links come to the driver.  No edges: an empty table.  ``rows``: about how many edges
    there are, if known, to write small tables in few tasks.
    """
    links = stored(_pairs(edges), f"{tag}-links", rows)
    left, levels = links.count(), []
    size = 2 * left
    while left:
        nearest = stored(_nearest(links, len(levels)), f"{tag}-nearest", 2 * left)
        to = stored(_rooted(nearest), f"{tag}-rooted", 2 * left)
        for _ in range(2):
            to = _followed(to)
        levels.append(stored(to, f"{tag}-pointers", 2 * left))
        links = stored(_pairs(_moved(_moved(links, "a", levels[-1]), "b", levels[-1])), f"{tag}-links", left)
        left = links.count()
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    reached = levels.pop().select("node", F.col("to").alias("root"))
    while levels:
        reached = _moved(levels.pop().select("node", F.col("to").alias("root")), "root", reached.select("node", F.col("root").alias("to")))
    reached = stored(reached, f"{tag}-reached", size)
    least = reached.groupBy("root").agg(F.min("node").alias("component"))
    return reached.join(least, "root").select("node", "component")


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _nearest(links: DataFrame, round_: int) -> DataFrame:
    """(node, to): the neighbour of the round's smallest hash."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    first = F.min(F.struct(F.xxhash64(F.lit(round_), "other").alias("hash"), "other"))
    return ends.groupBy("node").agg(first.alias("first")).select("node", F.col("first.other").alias("to"))


def _rooted(to: DataFrame) -> DataFrame:
    """Of two that point at each other the smaller points at itself."""
    step = to.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
    root = (F.col("_t") == F.col("node")) & (F.col("node") < F.col("to"))
    return to.join(step, F.col("to") == F.col("_n")).select("node", F.when(root, F.col("node")).otherwise(F.col("to")).alias("to"))


def _followed(to: DataFrame) -> DataFrame:
    step = to.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
    return to.join(step, F.col("to") == F.col("_n")).select("node", F.col("_t").alias("to"))


def _moved(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """``rows`` with what ``column`` leads to; nodes without pointers stay."""
    step = to.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
    moved = rows.join(step, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_t", column))
    return moved.select(*rows.columns)
