"""When messages go out: queues over days, and the next instant at which a business is open."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import numbered


def backlog(arrivals: DataFrame, limit: Column, last_day: str) -> DataFrame:
    """The queue of each kind by day: ``arrivals`` (kind, day, arrived) -> kind, day, arrived, sent_before, sent, waiting.

    Every day from a kind's first one to ``last_day`` takes ``limit`` messages, so waiting = max(0, waiting
    the day before + arrived - limit).  Unrolled that is a sum less its running minimum: with x the
    arrivals less the limits up to a day, waiting = x - min(0, all x up to it).  One row for each kind and day.
    """
    first = arrivals.groupBy("kind").agg(F.min("day").alias("first"))
    days = first.select("kind", F.explode(F.sequence("first", F.greatest(F.col("first"), F.lit(last_day).cast("date")))).alias("day"))
    filled = days.join(arrivals, ["kind", "day"], "left").fillna(0, ["arrived"]).withColumn("_limit", limit)
    order = Window.partitionBy("kind").orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = filled.withColumns({"_all": F.sum("arrived").over(so_far), "_x": F.sum(F.col("arrived") - F.col("_limit")).over(so_far)})
    summed = summed.withColumn("waiting", F.col("_x") - F.least(F.lit(0), F.min("_x").over(so_far)))
    done = summed.withColumn("_done", F.col("_all") - F.col("waiting"))
    before = F.coalesce(F.lag("_done").over(order), F.lit(0))
    return done.select("kind", "day", "arrived", before.alias("sent_before"), (F.col("_done") - before).alias("sent"), "waiting")


def carry_over(rows: DataFrame, limits: Mapping[str, int], order: list[str], last_day: str) -> DataFrame:
    """``rows`` (kind, day, ...) with send_day: those over a day's limit wait for the next days, first come first sent.

    Rows come in the order of day and ``order``, which has no ties.  ``limits``: messages a day by kind; a kind
    without one is not sent.  What is not sent until ``last_day`` stays queued, send_day null.  A kind may
    hold most rows: they are numbered over sorted ranges, and a message meets its day by number, not by a sort.
    """
    given = F.create_map(*(x for k, n in limits.items() for x in (F.lit(k), F.lit(int(n)))))
    width = F.lit(max(map(int, limits.values())))
    known = rows.where(F.col("kind").isin(*limits))
    queue = backlog(known.groupBy("kind", F.col("day").cast("date").alias("day")).agg(F.count("*").alias("arrived")), F.element_at(given, F.col("kind")), last_day)
    # A day sends the numbers from sent_before + 1 on: no more than the limit, so they lie in two steps of that width at most.
    spans = queue.where("sent > 0").select(F.col("kind").alias("_kind"), F.col("day").alias("_day"), F.col("sent_before").alias("_low"), (F.col("sent_before") + F.col("sent")).alias("_high"))
    spans = spans.withColumn("_step", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor((F.col("_high") - 1) / width))))
    ranked = numbered(known, ["kind"], ["day", *order], "_number").withColumn("_at", F.floor((F.col("_number") - 1) / width))
    met = (F.col("kind") == F.col("_kind")) & (F.col("_at") == F.col("_step")) & (F.col("_number") > F.col("_low")) & (F.col("_number") <= F.col("_high"))
    sent = ranked.join(spans, met, "left").select(*rows.columns, F.col("_day").alias("send_day"))
    none = rows.where(~F.coalesce(F.col("kind").isin(*limits), F.lit(False)))
    return sent.unionByName(none.withColumn("send_day", F.lit(None).cast("date")))


def minutes(clock: str) -> int:
    return int(clock[:2]) * 60 + int(clock[3:])


def open_hours(days: DataFrame, rules: Mapping) -> DataFrame:
    """The calendar of ``days`` (zone, first, last): zone, date, opens and closes in UTC on work days, and next_opens.

    ``rules``: the setting business.hours; its hours are local, so their instants move with daylight saving.
    One row for each zone and day; ``next_opens`` is the first opening on a later day.
    """
    dates = days.select("zone", F.explode(F.sequence("first", "last")).alias("date"))
    works = (F.weekday("date") + 1).isin(*rules["workdays"])

    def instant(clock: str) -> Column:
        local = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(minutes(clock)))
        return F.when(works, F.to_utc_timestamp(local.cast("timestamp"), F.col("zone")))

    found = dates.withColumns({"opens": instant(rules["start"]), "closes": instant(rules["end"])})
    later = Window.partitionBy("zone").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    return found.withColumn("next_opens", F.first("opens", ignorenulls=True).over(later))


def next_open(rows: DataFrame, time: str, rules: Mapping, zone: Column | None = None) -> DataFrame:
    """``rows`` with open_at: ``time`` (UTC) itself if the business is open then, else the next opening.

    ``zone``: a row's time zone, that of ``rules`` by default; a row without a time or zone gets null.  Each row
    meets one day of the calendar of its zone, by the local date; the calendar spans the rows' dates and
    two weeks more, some hundred rows a year and zone, so Spark sends it to the rows.
    """
    if not rules["workdays"]:
        return rows.withColumn("open_at", F.lit(None).cast("timestamp"))
    own = rows.withColumns({"_at": F.col(time).cast("timestamp"), "_zone": F.lit(rules["timezone"]) if zone is None else zone})
    own = own.withColumn("_date", F.to_date(F.from_utc_timestamp("_at", F.col("_zone"))))
    spans = own.where("_date is not null").groupBy(F.col("_zone").alias("zone")).agg(F.min("_date").alias("first"), F.date_add(F.max("_date"), 14).alias("last"))
    calendar = open_hours(spans, rules)
    joined = own.join(calendar, (F.col("_zone") == F.col("zone")) & (F.col("_date") == F.col("date")), "left")
    opened = F.when(F.col("_at") < F.col("opens"), F.col("opens")).when(F.col("_at") < F.col("closes"), F.col("_at")).otherwise(F.col("next_opens"))
    return joined.select(*rows.columns, opened.alias("open_at"))
