"""Histories, queues and schedules: windows by key over event-like rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key, of equal times the one of the smallest tie value; an aggregate, so it combines before its shuffle."""
    struct = F.struct(*(F.col(c) for c in rows.columns))
    best = rows.groupBy(key).agg(F.min_by(struct, F.struct(-F.unix_micros(F.col(time).cast("timestamp")), F.col(tie))).alias("r"))
    return best.select(*(F.col(f"r.{c}").alias(c) for c in rows.columns))


def transition_gaps(rows: DataFrame, key: str, state_from: str, state_to: str, order: Sequence[str]) -> DataFrame:
    """Rows whose ``from`` differs from the state before; a key's first row may come from null only."""
    before = F.lag(state_to).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("expected", before).where(~F.col(state_from).eqNullSafe(F.col("expected")))


def time_in_state(rows: DataFrame, key: str, time: str, order: Sequence[str]) -> DataFrame:
    """``micros`` until the key's next row; null for its last."""
    following = F.lead(time).over(Window.partitionBy(key).orderBy(*order))

    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    return rows.withColumn("micros", micros(following) - micros(F.col(time)))


def due_queue(rows: DataFrame, ready: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` ready rows; a top-k, so no task sorts all rows."""
    return rows.where(ready).orderBy(*order).limit(n)


def daily_cap(rows: DataFrame, day: Column, contact: str, order: Sequence[str], per_day: int, per_contact: int) -> DataFrame:
    """At most ``per_contact`` rows of a contact and then ``per_day`` rows of a day, in order."""
    own = rows.withColumn("day", day)
    by_contact = Window.partitionBy("day", contact).orderBy(*order)
    own = own.withColumn("_c", F.row_number().over(by_contact)).where(F.col("_c") <= per_contact)
    by_day = Window.partitionBy("day").orderBy(*order)
    return own.withColumn("slot", F.row_number().over(by_day)).where(F.col("slot") <= per_day).drop("_c")


def followup_schedule(rows: DataFrame, sent: str, offsets: Sequence[int]) -> DataFrame:
    """One row for each follow-up: (…, sequence_step from 1, scheduled_at); each offset counts from the message before."""
    total, days = 0, []
    for step, offset in enumerate(offsets, 1):
        total += offset
        days.append(F.struct(F.lit(step).alias("sequence_step"), F.lit(total).alias("days")))
    out = rows.withColumn("_f", F.explode(F.array(*days)))
    return out.select(*rows.columns, "_f.sequence_step", (F.col(sent) + F.make_dt_interval(days=F.col("_f.days"))).alias("scheduled_at"))


def in_business_hours(utc: Column, rules: Mapping) -> Column:
    """Whether a time in UTC is, in the zone of ``rules``, on one of its work days (1 Monday to 7 Sunday) from start until before end.

    ``rules``: the setting business.hours (timezone, workdays, start and end as HH:MM).
    """
    local = F.from_utc_timestamp(utc, rules["timezone"])
    start, end = (int(t[:2]) * 60 + int(t[3:]) for t in (rules["start"], rules["end"]))
    minute = F.hour(local) * 60 + F.minute(local)
    return (F.weekday(local) + 1).isin(*rules["workdays"]) & (minute >= start) & (minute < end)


def send_limits(rows: DataFrame, limits: Mapping, campaigns: DataFrame, order: Sequence[str]) -> DataFrame:
    """The messages that may be sent: ``rows`` (day, kind, contact, campaign_id, ...) in order, with ``slot`` of the day and kind.

    A contact gets at most ``max_per_contact`` a day, a campaign sends at most its ``daily_limit`` a day
    (``campaigns``: campaign_id, daily_limit; none or null: no limit), and each kind (outreach, followup)
    at most its own limit of ``limits``, the setting outreach.email.daily_limit; other kinds are not sent.
    Where limits are small, Spark keeps that many rows of a group in each task before it shuffles.
    """
    by_contact = Window.partitionBy("day", "contact").orderBy(*order)
    own = rows.withColumn("_c", F.row_number().over(by_contact)).where(F.col("_c") <= int(limits["max_per_contact"])).drop("_c")
    capped = campaigns.select(F.col("campaign_id").alias("_id"), F.col("daily_limit").alias("_limit"))
    own = own.join(capped, F.col("campaign_id") == F.col("_id"), "left").drop("_id")
    # Rows without a limited campaign stand alone, so that they are no hot key.
    own = own.withColumn("_own", F.when(F.col("_limit").isNull(), F.monotonically_increasing_id()))
    by_campaign = Window.partitionBy("day", "campaign_id", "_own").orderBy(*order)
    own = own.withColumn("_n", F.row_number().over(by_campaign)).where(F.col("_limit").isNull() | (F.col("_n") <= F.col("_limit"))).drop("_n", "_limit", "_own")
    by_kind = Window.partitionBy("day", "kind").orderBy(*order)
    most = F.when(F.col("kind") == "outreach", int(limits["outreach"])).when(F.col("kind") == "followup", int(limits["followup"]))
    # One chain for both kinds; the larger limit stands alone too, so that a task keeps no more rows of a group than that.
    placed = own.where(F.col("kind").isin("outreach", "followup")).withColumn("slot", F.row_number().over(by_kind))
    return placed.where(F.col("slot") <= max(int(limits["outreach"]), int(limits["followup"]))).where(F.col("slot") <= most)


def notified(priority: Column, classification: Column, rules: Mapping) -> Column:
    """``now`` for what the setting notifications.rules tells at once (critical and high exceptions, interested replies), else its digest."""
    at_once = F.lit(False)
    for level in ("CRITICAL", "HIGH"):
        if rules[f"{level.lower()}_exceptions"]:
            at_once = at_once | F.coalesce(priority == level, F.lit(False))
    if rules["buying_intent"]:
        at_once = at_once | F.coalesce(classification == "INTERESTED", F.lit(False))
    return F.when(at_once, "now").otherwise(F.lit(rules["digest"]))


def price_cents(months: Column, setup_fee_cents: int, hosting_monthly_cents: int) -> Column:
    """The setup fee and the hosting of some months, in whole cents."""
    return F.lit(int(setup_fee_cents)).cast("long") + months.cast("long") * int(hosting_monthly_cents)
