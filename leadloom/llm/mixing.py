"""Mixing sources to target weights (operator 1), in DataFrame functions alone.

Leaves are the paths (domain, language, source).  The token budget falls from the root: each node
divides its own among its children by weight, but no child gets more than its subtree can give
(tokens times ``epochs``), and what a full child leaves over goes to its siblings; only what no sibling
can take comes back to the node's own siblings, since a node's capacity is the sum of its children's.
A leaf's budget is met by whole passes over its documents and a token-prefix of one more pass, each in
an order of its own by a seeded hash.  The prefix is found by radix: sums of tokens by the hash's first
digits, then by the next ones inside the one bucket where the prefix ends, then documents inside one of these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import quoted, stored

LEVELS = ("domain", "lang", "source")
#: Production parameters: tokens per thousand of all tokens, passes over one leaf at most, seed.
BUDGET_PER_MILLE, EPOCHS, SEED = 600, 2, "mix-1"
#: Weights by level and name; names that are not listed weigh DEFAULT_WEIGHT.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 3}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
DEFAULT_WEIGHT = 1
_DIGITS, _RADIX = 3, 2  # hex digits of the hash that name a bucket, levels of buckets in buckets
_WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """The domain of a source: d0, d1 or d2 by the crc32 of its name; a null source counts as an empty name."""
    return F.concat(F.lit("d"), F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % 3)


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    own = weights.get(level, {})
    out = F.lit(DEFAULT_WEIGHT).cast("long")
    for name, w in own.items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _divide(children: DataFrame, up: Sequence[str], level: str, weights: dict) -> DataFrame:
    """``children`` (up..., level, capacity, total: their parent's budget) with ``budget``.

    Children are filled in the order of capacity by weight: one is full if the budget, shared by weight
    among it and those after it, reaches its capacity.  The others share the rest by weight; rounding is
    by differences of the floors of running sums, so the sum is exact.
    """
    joined = children.withColumn("w", _weight(level, weights))
    ratio = [F.col("capacity") / F.col("w"), F.asc_nulls_first(level)]
    own = Window.partitionBy(*(up or [F.lit(0)]))
    so_far = own.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = joined.withColumns({"c": F.sum("capacity").over(so_far), "v": F.sum("w").over(so_far), "all": F.sum("w").over(own)})
    # full: capacity / w <= (total - capacity of those before) / (weight of it and those after)
    left, after = F.col("total") - F.col("c") + F.col("capacity"), F.col("all") - F.col("v") + F.col("w")
    s = s.withColumn("full", _wide(F.col("capacity")) * _wide(after) <= _wide(left) * _wide(F.col("w")))
    s = s.withColumns({"rest": F.col("total") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(own), "wrest": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(own)})
    run = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(so_far)
    s = s.withColumn("run", run)

    def share(weight: Column) -> Column:
        return F.floor(_wide(F.col("rest")) * _wide(weight) / _wide(F.greatest(F.col("wrest"), F.lit(1)))).cast("long")

    budget = F.when(F.col("full"), F.col("capacity")).otherwise(share(F.col("run")) - share(F.col("run") - F.col("w")))
    return s.select(*up, level, "capacity", budget.alias("budget"))


def budgets(leaves: DataFrame, total: Column, levels: Sequence[str] = LEVELS, weights: dict = WEIGHTS) -> DataFrame:
    """``leaves`` (levels..., capacity) -> (levels..., capacity, budget); ``total`` in terms of ``capacity``, the sum."""
    nodes = None
    for k, level in enumerate(levels):
        up = list(levels[:k])
        children = leaves.groupBy(*up, level).agg(F.sum("capacity").alias("capacity"))
        if nodes is None:
            # The children of the root are few rows; their sum, a window, is the root's.
            whole = children.withColumn("all", F.sum("capacity").over(Window.partitionBy(F.lit(0)))).select("*", F.col("capacity").alias("own"))
            children = whole.withColumn("capacity", F.col("all")).withColumn("total", total).select(level, F.col("own").alias("capacity"), "total")
        else:
            children = children.join(nodes.select(*up, F.col("budget").alias("total")), up)
        nodes = _divide(children, up, level, weights)
    return nodes


def mix(docs: DataFrame, per_mille: int = BUDGET_PER_MILLE, epochs: int = EPOCHS, seed: str = SEED, weights: dict = WEIGHTS) -> DataFrame:
    """Choose documents of ``docs`` (doc_id, text, lang, source), each with the tokens to take of it.

    Returns doc_id, row (a number of the input row), content (a hash of the text), domain, lang, source, epoch (from 0), n_tokens and
    take_tokens: at most one document of a leaf and epoch is cut.  The budget is ``per_mille`` of all
    tokens (words), at most ``epochs`` times a leaf's.  Null domains, languages and sources are names of
    their own, written as empty; null or empty texts have no tokens and are never chosen; equal rows are
    chosen each; the order among equal hashes is by doc_id and row.  No rows or tokens: an empty table.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("source")).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.xxhash64("text").alias("content"), F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_tokens"),
    ).where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id())
    slim = stored(slim, "mix-rows")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = stored(leaves.withColumn("capacity", F.col("tokens") * epochs), "mix-leaves")
    total = F.floor(F.col("capacity") / epochs * per_mille / 1000).cast("long")
    shares = budgets(leaves.select(*LEVELS, "capacity"), total, weights=weights).select(*LEVELS, "budget")
    plan = leaves.join(shares, list(LEVELS)).select(
        *LEVELS, F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("passes"), (F.col("budget") % F.col("tokens")).alias("prefix")
    )
    # A row for each leaf; with few leaves it is broadcast by its size, else joined by a shuffle.
    plan = stored(plan, "mix-plan")
    rows = slim.join(plan, list(LEVELS))
    order = F.md5(F.concat_ws("|", F.lit(seed), "passes", "doc_id").cast("binary"))
    last = stored(rows.where("prefix > 0").withColumn("hash", order), "mix-last")
    whole, open_ = [], last.withColumn("before", F.lit(0).cast("long"))
    up_to = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(_RADIX):
        # Of a leaf's buckets one may hold the end of the prefix; those before it are taken whole.
        dealt = open_.withColumn("bucket", F.substring("hash", 1 + _DIGITS * level, _DIGITS))
        sums = dealt.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("sum"), F.first("prefix").alias("prefix"), F.first("before").alias("start"))
        sums = sums.withColumn("at", F.col("start") + F.sum("sum").over(up_to) - F.col("sum")).where(F.col("at") < F.col("prefix"))
        sums = sums.select(*LEVELS, "bucket", "at", (F.col("at") + F.col("sum") <= F.col("prefix")).alias("whole"))
        cut = dealt.join(sums, [*LEVELS, "bucket"])
        whole.append(cut.where("whole"))
        open_ = stored(cut.where("not whole").withColumn("before", F.col("at")).select(*open_.columns), "mix-open")
    inside = Window.partitionBy(*LEVELS).orderBy("hash", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = open_.withColumn("start", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).where(F.col("start") < F.col("prefix"))
    columns = ["doc_id", "row", "content", *LEVELS]
    full = rows.where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    out = full.select(*columns, "epoch", "n_tokens", F.col("n_tokens").alias("take_tokens"))
    for part in whole:
        out = out.union(part.select(*columns, F.col("passes").alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens")))
    return out.union(ends.select(*columns, F.col("passes").alias("epoch"), "n_tokens", F.least(F.col("n_tokens"), F.col("prefix") - F.col("start")).alias("take_tokens")))


def texts(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that ``mix`` chooses, once for each pass, cut texts cut after their last token.

    Equal rows are numbered: a pass takes as many of them whole as it chooses, and cuts the next one, so
    the tokens are those of ``mix``.  A cut text keeps its white space between the tokens it keeps.
    Columns of ``docs`` may have any names.
    """
    names = docs.columns
    key = ["doc", "content", "lang", "source"]
    part = F.col("take_tokens") < F.col("n_tokens")
    passes = mix(docs, **limits).withColumnRenamed("doc_id", "doc").groupBy(*key, "epoch")
    passes = passes.agg(F.count_if(~part).alias("whole"), F.max(F.when(part, F.col("take_tokens"))).alias("take"))
    # At most one entry for each pass.
    chosen = passes.groupBy(*key).agg(F.collect_list(F.struct("whole", "take")).alias("passes"))
    keyed = docs.select(
        F.struct(*(F.col(quoted(n)) for n in names)).alias("r"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("content"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
    )
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("doc")))
    same = F.col("d.doc").eqNullSafe(F.col("c.doc"))
    for k in key[1:]:
        same = same & (F.col(f"d.{k}") == F.col(f"c.{k}"))
    one = keyed.alias("d").join(chosen.alias("c"), same).select("d.r", "d.nth", F.explode("c.passes").alias("p"))
    one = one.where((F.col("nth") <= F.col("p.whole")) | ((F.col("nth") == F.col("p.whole") + 1) & F.col("p.take").isNotNull()))
    text = F.col("r.text")
    words = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    # The first part holds no word if the text starts with white space.
    lead = F.when(F.regexp_like(text, F.lit(r"^[\x20\x09-\x0D]")), 1).otherwise(0)
    cut = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), F.col("p.take").cast("int") + lead), ""), r"[\x20\x09-\x0D]+$", "")
    new = F.when(F.col("nth") > F.col("p.whole"), cut).otherwise(text)
    return one.select(*(new.alias("text") if n == "text" else F.col(f"r.{quoted(n)}").alias(n) for n in names))
