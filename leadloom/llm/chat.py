"""Chat formatting by event-sourced reconstruction (operator 4), in DataFrame functions alone.

A log holds events (conv_id, seq, kind, msg, role, text).  Kinds: ``message`` opens a message, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` empties it and drops all messages of the
conversation with a larger ``msg`` whose last event came before.  Events are shuffled once, by
conversation, folded by message and rendered.  Everything is read back from the rendered text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed marks of the template: a turn is OPEN role newline text CLOSE newline.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings that texts may not hold as such: the template's own and those of common other ones.
_CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>|\|system\|>|\|user\|>|\|assistant\|>"
#: A control string is broken by a backslash after its first character; one already so broken gets another.
FIND, _BREAK = rf"(<|\[)(\\*)({_CONTROL})", r"$1\\$2$3"
_BROKEN, _JOIN = rf"(<|\[)\\(\\*)({_CONTROL})", r"$1$2$3"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, FIND, _BREAK)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _BROKEN, _JOIN)


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def turn_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as one ``message`` event each.

    Rows of equal turn are messages of their own, ordered by role and text; null turns come last.  Rows
    without a conv_id are conversations of one message each.
    """
    order = Window.partitionBy(*_OWN).orderBy(F.asc_nulls_last("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return _lone(rows).select(*_OWN, F.row_number().over(order).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text").withColumn("msg", F.col("seq"))


#: What names a conversation: its id, or the number of a row that has none, so that such rows are no hot key.
_OWN = ("conv_id", "lone")


def _lone(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, lone, msg, role, text): the final messages of a log.

    Null texts and roles are empty; null kinds count as ``message``; unknown kinds are ignored.  Events
    go by sequence number; equal ones by kind (delta, edit, message, regenerate), then text.  A message is
    what its last event other than a delta says, and the deltas after it; its role is that of its last
    event with one.  Events without a conv_id are conversations of their own.  No events: an empty table.
    """
    events = events if "lone" in events.columns else _lone(events)
    rows = events.select(
        *_OWN, "msg", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")
    ).where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    at = F.struct("seq", "kind", "text")
    own = Window.partitionBy(*_OWN, "msg")
    rows = rows.withColumn("reset", F.max(F.when(F.col("kind") != "delta", at)).over(own))
    # Of events that equal the reset in all respects one is the message; the others are replaced by it.
    rows = rows.withColumn("said", F.when(F.col("kind") != "regenerate", F.col("text")).otherwise(""))
    after = F.col("reset").isNull() | (at > F.col("reset"))
    start = F.first(F.when(at == F.col("reset"), F.col("said")), ignorenulls=True)
    folded = rows.groupBy(*_OWN, "msg").agg(
        F.max("seq").alias("last"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.struct(at, "role"))), F.lit("")).alias("role"),
        F.concat(F.array(F.coalesce(start, F.lit(""))), F.transform(F.array_sort(F.collect_list(F.when(after, at))), lambda p: p["text"])).alias("parts"),
    )
    before = Window.partitionBy(*_OWN).orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumn("superseded", F.max("regenerated").over(before))
    live = folded.where(F.col("superseded").isNull() | (F.col("last") > F.col("superseded")))
    return live.select(*_OWN, "msg", "role", F.array_join("parts", "").alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of (conv_id, lone, msg, role, text).

    ``loss_spans``: (start, length) in code points of ``formatted`` for the text of each assistant turn.
    """
    head = F.concat(F.lit(OPEN), _role_out(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    turns = messages.select(*_OWN, F.struct("msg", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("learn")).alias("t"))
    turns = turns.groupBy(*_OWN).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    tail = f"{CLOSE}\n"
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def size(c: Column) -> Column:
        return F.length(c).cast("long")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + size(t["head"])
        span = F.array(F.struct(start.alias("start"), size(t["body"]).alias("length")))
        return F.struct(
            (start + size(t["body"]) + len(tail)).alias("at"), F.when(t["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    return turns.select("conv_id", formatted.alias("formatted"), F.aggregate("turns", state, step, lambda acc: acc["spans"]).alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns, (role, text), that a rendered conversation holds."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p, i: i > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            _role_in(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(F.regexp_extract(p, rf"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text"),
        ),
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of ``conversations`` (conv_id, turn, role, text)."""
    return rendered(reconstruct(turn_events(conversations)))


def digests(chats: DataFrame) -> DataFrame:
    """What op4 returns, taken from ``formatted`` and ``loss_spans`` alone."""
    cut = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = chats.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), F.array_join(cut, "").alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
