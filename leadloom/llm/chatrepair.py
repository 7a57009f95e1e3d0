"""Cheapest edits that repair the structure of conversations (operator 13).

A weight is one integer: its high digits are the cost, its low digits the audit letters, the first one
at the highest of a fixed number of places and zeros behind the last, so the least weight is the
cheapest edit and of equally cheap ones the one whose letters come first.  Conversations are weighed
from their last row to their first: a letter is added at the highest place after the others have moved
one place down, which keeps their order.  The role states are none yet, system, user and assistant.

Rows are dealt by ranges of (conversation, turn, role, text), so that a conversation may lie in many
tasks, and are weighed in segments of bounded length.  All ways through the same rows end with the
letter of the last one, so none is the beginning of another: their order never depends on what
follows.  A segment is therefore told in full by the cost and the order of its ways from each state to
each; these few numbers are chained over a conversation's segments to choose its ways.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_batches, stored

BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
#: Rows weighed at a time.
SEGMENT = 256
#: Costs of keeping, giving another role, deleting, inserting, and of leaving a truncated row.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
D, I, K, R = 1, 2, 3, 4
LETTERS = "_DIKR"
#: By state (0 none yet, 1 system, 2 user, 3 assistant): the states after kept rows by initial, and after a row of the only role that may be given.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN, ROLES = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Rows to insert at the end of a conversation in each state.
OPEN = (0, 2, 1, 0)

_FACTS = "n_rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, min_turn long, max_turn long, n_turns long"
_SEGMENT = f"conv_id long, part int, seg long, whole boolean, {_FACTS}, costs array<long>, orders array<int>, audits array<string>, repaired_sha256 string, rows array<struct<role:string,text:string>>"
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int64()), ("whole", pa.bool_())]
    + [(n, pa.string() if n.endswith("initial") else pa.int64()) for n in (f.split()[0] for f in _FACTS.split(", "))]
    + [("costs", pa.list_(pa.int64())), ("orders", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), ("repaired_sha256", pa.string())]
    + [("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Weights:
    """Integers with ``places`` letters below the cost."""

    def __init__(self, places: int):
        self.bits = 3 * places
        self.mask = (1 << self.bits) - 1

    def moved(self, weight: int | None) -> int | None:
        """The weight with its letters one place down."""
        if weight is None:
            return None
        low = weight & self.mask
        return weight - low + (low >> 3)

    def edge(self, cost: int, letter: int) -> int:
        return (cost << self.bits) + (letter << (self.bits - 3))

    def letters(self, weight: int) -> str:
        low, out, shift = weight & self.mask, [], self.bits
        while low and shift:
            shift -= 3
            out.append(LETTERS[low >> shift])
            low &= (1 << shift) - 1
        return "".join(out)

    def through(self, rows: list[tuple[str, bool, bool]], ends: list[int | None]) -> list[int | None]:
        """The least weights from each state through ``rows`` (initial, forced, truncated), given those after the last row.

        At most one row is inserted before each: two in a row cost 10 and lead from none and assistant where
        one or no insertion leads, from user back to user, and after a kept system row deleting it costs 2.
        """
        insert, delete = self.edge(INSERT, I), self.edge(DELETE, D)
        kept = [self.edge(KEEP + TRUNCATED * x, K) for x in (0, 1)]
        given = [self.edge(REROLE + TRUNCATED * x, R) for x in (0, 1)]
        best = ends
        for initial, forced, truncated in reversed(rows):
            moved, base = [self.moved(w) for w in best], []
            for state in range(4):
                ways = [] if moved[state] is None else [moved[state] + delete]
                if not forced:
                    after = AFTER[state].get(initial)
                    if after is not None and moved[after] is not None:
                        ways.append(moved[after] + kept[truncated])
                    if moved[GIVEN[state]] is not None:
                        ways.append(moved[GIVEN[state]] + given[truncated])
                base.append(min(ways, default=None))
            moved, best = [self.moved(w) for w in base], []
            for state in range(4):
                ways = [] if base[state] is None else [base[state]]
                if moved[GIVEN[state]] is not None:
                    ways.append(moved[GIVEN[state]] + insert)
                best.append(min(ways, default=None))
        return best


def whole_way(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) of a conversation from its first row to its last."""
    w = Weights(2 * len(rows) + 2)
    ends: list[int | None] = [0, None, None, 0]
    ends[2] = w.moved(ends[3]) + w.edge(INSERT, I)
    ends[1] = w.moved(ends[2]) + w.edge(INSERT, I)
    least = w.through(rows, ends)[0]
    return least >> w.bits, w.letters(least)


def segment_ways(rows: list[tuple[str, bool, bool]]) -> tuple[list[int | None], list[int | None], list[str | None]]:
    """(costs, orders, audits) of the least ways from each state to each, at 4 * from + to; orders are among the ways from a state."""
    w = Weights(2 * len(rows) + 2)
    ways = [w.through(rows, [0 if k == end else None for k in range(4)]) for end in range(4)]
    costs, orders, audits = [None] * 16, [None] * 16, [None] * 16
    for start in range(4):
        own = {end: ways[end][start] for end in range(4) if ways[end][start] is not None}
        for order, end in enumerate(sorted(own, key=lambda e: own[e] & w.mask)):
            at = 4 * start + end
            costs[at], orders[at], audits[at] = own[end] >> w.bits, order, w.letters(own[end])
    return costs, orders, audits


def edited(rows: list, audit: str, state: int = 0) -> tuple[list[tuple[str, str]], int]:
    """The rows (role, text), or None for one that must go, after the edits of ``audit``, and the state at the end."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            out.append((ROLES[state], ""))
        elif letter == "K":
            out.append(rows[at])
        elif letter == "R":
            out.append((ROLES[state], rows[at][1]))
        if letter != "D":
            state = AFTER[state][rows[at][0][:1]] if letter == "K" else GIVEN[state]
        at += letter != "I"
    return out, state


class Digest:
    """The hash of ``role:text`` of rows joined by newlines, taken row by row."""

    def __init__(self):
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, rows: list[tuple[str, str]]) -> None:
        for role, text in rows:
            self.hash.update((b"\n" if self.begun else b"") + role.encode() + b":" + text.encode())
            self.begun = True


def _segments(size: int):
    """Sorted rows of a range -> the segments of its conversations; those that may go on in a neighbour are not ``whole``."""

    def record(conv, part: int, seg: int, whole: bool, rows: list) -> dict:
        turns = [r[0] for r in rows if r[0] is not None]
        initials = [r[1][:1] for r in rows]
        kinds = [(r[1][:1], r[3] in ("blank", "duplicate"), r[3] == "truncated") for r in rows]
        content = [None if forced else (r[1], r[2]) for r, (_, forced, _) in zip(rows, kinds)]
        out = {
            "conv_id": conv, "part": part, "seg": seg, "whole": whole, "n_rows": len(rows), **{f: sum(r[3] == f for r in rows) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "first_initial": initials[0], "last_initial": initials[-1],
            "min_turn": min(turns, default=None), "max_turn": max(turns, default=None), "n_turns": len(set(turns)),
            "rows": [None if c is None else {"role": c[0], "text": c[1]} for c in content],
        }
        if whole:
            cost, audit = whole_way(kinds)
            digest = Digest()
            digest.add(edited(content, audit)[0])
            return out | {"costs": [cost], "orders": [0], "audits": [audit], "repaired_sha256": digest.hash.hexdigest()}
        return out | dict(zip(("costs", "orders", "audits"), segment_ways(kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), [], 0
        conv, rows, seg, alone = None, [], 0, False  # the first conversation may have begun before
        for batch in batches:
            for own, *row, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "n"))):
                if rows and own != conv:
                    made.append(record(conv, part, seg, alone, rows))
                    rows, seg, alone = [], seg + 1, True
                conv = own
                again = "blank" if row[3] == "blank" else "duplicate"
                for fault in chain((row[3],), repeat(again, n - 1)):
                    if len(rows) == size:
                        made.append(record(conv, part, seg, False, rows))
                        rows, seg, alone = [], seg + 1, False
                    rows.append((*row[:3], fault))
                held += len(row[2])
                if held > 1 << 20 or len(made) >= 1000:
                    if made:
                        yield pa.RecordBatch.from_pylist(made, schema=_ARROW)
                    made, held = [], 0
        if rows:
            made.append(record(conv, part, seg, False, rows))
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=_ARROW)

    return run


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of sorted batches as tuples, the first value a conversation's number: it rises by one where a new one begins."""
    number, last = -1, object()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if row[0] != last:
                number, last = number + 1, row[0]
            yield (number, *row)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each conversation from the last to the first -> the states at which each is entered and left."""
    part, seg, leave, after, current = array("i"), array("q"), bytearray(), [INSERT * n for n in OPEN], None

    def flush() -> pa.RecordBatch:
        """The choices of one conversation, from its first segment on: 16 bytes a segment were kept of it."""
        state, states = 0, []
        for k in range(len(part) - 1, -1, -1):
            left = leave[4 * k + state]
            states.append((part[k], seg[k], state, left))
            state = left
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*states), (pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names=["part", "seg", "enter", "leave"])

    for number, _, own_part, own_seg, costs, orders in _runs(batches, ("conv_id", "part", "seg", "costs", "orders")):
        if current is not None and number != current:
            yield flush()
            part, seg, leave, after = array("i"), array("q"), bytearray(), [INSERT * n for n in OPEN]
        current, before = number, []
        for start in range(4):
            cost, _, end = min((costs[4 * start + e] + after[e], orders[4 * start + e], e) for e in range(4) if costs[4 * start + e] is not None)
            leave.append(end)
            before.append(cost)
        part.append(own_part)
        seg.append(own_seg)
        after = before
    if current is not None:
        yield flush()


_MERGED = ("conv_id", "n_rows", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "min_turn", "max_turn", "n_turns", "cost", "audit", "enter", "rows")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their chosen ways, in order -> a row for each conversation; a segment's rows are let go once they are hashed."""
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _RESULT.split(", ")])
    current, sums = None, None

    def flush() -> pa.RecordBatch:
        more = OPEN[sums["state"]]
        sums["digest"].add([(ROLES[s], "") for s in ((1, 2) if more == 2 else (2,))[:more]])
        gaps = 0 if sums["low"] is None else sums["high"] - sums["low"] + 1 - sums["turns"]
        values = [sums["conv"], gaps, *sums["faults"], sums["illegal"], sums["cost"] + INSERT * more, "".join([*sums["audits"], "I" * more]), sums["digest"].hash.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    for number, conv, _, blank, duplicate, truncated, illegal, first, last, low, high, turns, cost, audit, enter, rows in _runs(batches, _MERGED):
        if number != current:
            if sums is not None:
                yield flush()
            current = number
            sums = {"conv": conv, "faults": [0, 0, 0], "illegal": 0, "last": None, "low": None, "high": None, "turns": 0, "cost": 0, "audits": [], "digest": Digest(), "state": 0}
        sums["faults"] = [a + b for a, b in zip(sums["faults"], (blank, duplicate, truncated))]
        sums["illegal"] += illegal + (sums["last"] is not None and sums["last"] + first not in ("su", "ua", "au"))
        sums["last"] = last
        if low is not None:
            sums["turns"] += turns - (sums["high"] == low)
            sums["low"], sums["high"] = low if sums["low"] is None else sums["low"], high
        sums["cost"] += cost
        sums["audits"].append(audit)
        made, sums["state"] = edited([None if r is None else (r["role"], r["text"]) for r in rows], audit, enter)
        sums["digest"].add(made)
    if sums is not None:
        yield flush()


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault, n) of ``rows``: equal ones once with their number, fault the first one's or null.

    A copy's fault is ``blank`` if that is the first one's, else ``duplicate``.  Texts count as equal if
    two 64-bit hashes are.
    """
    null = F.lit(" ")
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), null).alias(c) for c in ("role", "text")))
    # Keys without nulls, so that the join below keeps the partitioning of the first aggregate.
    key = {"conv": F.coalesce("conv_id", F.lit(0)), "lone": F.col("conv_id").isNull(), "at": F.coalesce("turn", F.lit(0)), "late": F.col("turn").isNotNull(), "role": F.col("role"), "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")}
    each = own.select(*(c.alias(n) for n, c in key.items()), "text").groupBy(*key).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    body = F.rtrim("text", F.lit(BLANKS))
    each = each.withColumn("blank", body == "")
    same = ("conv", "lone", "role", "h1", "h2")
    firsts = each.where(~F.col("blank")).groupBy(*same).agg(F.min(F.struct("late", "at")).alias("m")).select(*same, "m.late", "m.at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.right(body, F.lit(1)).isin(*STOPS), "truncated")
    joined = each.join(firsts, list(key), "left")
    return joined.select(F.when(~F.col("lone"), F.col("conv")).alias("conv_id"), F.when(F.col("late"), F.col("at")).alias("turn"), "role", "text", fault.alias("fault"), "n")


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The written segments of all conversations of ``rows``, each with all its ways or, if ``whole``, with its one result."""
    # The range's key holds the start of a text, which keeps the order of texts and the driver's sample of keys small.
    ranged = faults(rows).withColumn("begin", F.substring("text", 1, 64)).repartitionByRange("conv_id", "turn", "role", "begin").drop("begin")
    return stored(ranged.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_segments(size), _SEGMENT), "chat-segments")


def decided(parts: DataFrame) -> DataFrame:
    """``segments`` with the state at which each is entered and its audit and cost."""
    whole = parts.where("whole").withColumns({"enter": F.lit(0), "audit": F.get("audits", F.lit(0)), "cost": F.get("costs", F.lit(0))})
    cut = parts.where(~F.col("whole"))
    narrow = cut.select("conv_id", "part", "seg", "costs", "orders").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
    chosen = stored(narrow.mapInArrow(_chain, "part int, seg long, enter int, leave int"), "chat-chain")
    way = 4 * F.col("enter") + F.col("leave")
    joined = cut.join(chosen, ["part", "seg"]).withColumns({"audit": F.get("audits", way), "cost": F.get("costs", way)})
    return whole.unionByName(joined.drop("leave"))


def repair(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """What is wrong in each conversation of ``rows`` (conv_id, turn, role, text) and its cheapest repair.

    Rows are in the order of turn, nulls first, then role and text.  Returns conv_id, gaps (turns that
    are missing between the least and the greatest), blank, duplicate, truncated, illegal (neighbours
    whose role initials are not su, ua or au), cost, audit (the letters of the edits) and
    repaired_sha256.  Null roles and texts count as one space, which is blank; rows without a conv_id are one
    conversation; equal rows are duplicates of one of them; other columns are ignored.  No rows give none.
    A conversation's audit and hash are one value, so its rows meet in one task at the end, a segment at a time.
    """
    small_batches(rows.sparkSession)
    found = decided(segments(rows, size))
    gaps = F.when(F.col("min_turn").isNull(), 0).otherwise(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"))
    whole = found.where("whole").select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    cut = found.where(~F.col("whole")).select(*_MERGED, "part", "seg").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return whole.unionByName(cut.mapInArrow(_merge, _RESULT))


def repaired_rows(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (part, seg, nth; their order) , role, text.

    The rows that the end of a conversation lacks follow at the place after its last segment.
    """
    small_batches(rows.sparkSession)
    schema = "conv_id long, part int, seg long, nth int, role string, text string"
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, seg, enter, audit, own in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "seg", "enter", "audit", "rows"))):
                made, _ = edited([None if r is None else (r["role"], r["text"]) for r in own], audit, enter)
                out += [(conv, part, seg, n, *r) for n, r in enumerate(made)]
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in schema.split(", ")])

    found = decided(segments(rows, size))
    inner = found.select("conv_id", "part", "seg", "enter", "audit", "rows").mapInArrow(run, schema)
    # What a cut conversation lacks at its end depends on the state that its last segment leaves.
    last = found.where(~F.col("whole")).groupBy("conv_id").agg(F.max_by(F.struct("part", "seg", "enter", "audit", "rows"), F.struct("part", "seg")).alias("x"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, x in zip(batch.column("conv_id").to_pylist(), batch.column("x").to_pylist()):
                _, state = edited([None if r is None else (r["role"], r["text"]) for r in x["rows"]], x["audit"], x["enter"])
                more = {1: ROLES[1:3], 2: ROLES[2:3]}.get(state, ())
                out += [(conv, x["part"], x["seg"] + 1, n, role, "") for n, role in enumerate(more)]
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return inner.unionByName(last.mapInArrow(ends, schema))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; nulls: one space) with the faults that the crc32 of ``conv_id:turn`` draws.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and
    question marks, 3 repeats it and 4 makes its role user.
    """

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    drawn = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1)))
    return drawn.where("d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def audits(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The repair of ``damaged`` rows for every conv_id of ``rows``; one that has lost all its rows has zeros and nothing to repair."""
    names = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = repair(damaged(rows), size)
    joined = names.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
    zero = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return joined.fillna(zero | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
