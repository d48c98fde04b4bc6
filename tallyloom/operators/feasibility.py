"""Gate 8 by counts of days: which pairings of lines and events some largest assignment uses.

Past the gates that look at one pair, a line of an amount and currency accepts
each event of the same amount and currency that was made on its day or up to
window_days before.  Lines of one day are alike, and so are events of one day, so
the graph of an amount is two counts a day, however many rows there are.

Taking days in order and giving each line the oldest event left is a largest
assignment.  Its state is one number, how many events are gone (taken, or too old
for all lines to come), counted from the oldest; and how many lines to come can
still be served falls by one for each event gone beyond a slack that a pass
backwards gives.  A pairing is in some largest assignment if forcing it, and
serving the days up to the event's last one anew, leaves as many served in all.

Amounts with no days, null days or currencies make no pairing.  Days that lie
further apart than the window are in stretches of their own, which do not touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEY = ("amount_paise", "currency")
PAIR = (*KEY, "settled_on", "created_on")
#: More events than there are: no slack is used up.
_ALL = 1 << 62


def _struct(**columns: Column) -> Column:
    return F.struct(*(c.cast("long").alias(k) for k, c in columns.items()))


def sweeps(pairs: DataFrame, window_days: int) -> DataFrame:
    """A row for each day of an amount: its lines and events, and what the passes find.

    pairs: PAIR, n_lines and n_events, a row for each pair of days within the window.
    seen: events up to the day; old: those too old for its lines; before, after:
    events gone before and after it; matched: lines served; slack: events that may
    be gone after it at no loss to later days.
    """
    by_day = lambda day, n, a, b: pairs.groupBy(*KEY, F.unix_date(F.to_date(day)).alias("day")).agg(F.max(n).alias("n")).select(*KEY, "day", a.alias("lines"), b.alias("events"))
    n, zero = F.col("n"), F.lit(0).cast("long")
    days = by_day("settled_on", "n_lines", n, zero).unionByName(by_day("created_on", "n_events", zero, n)).groupBy(*KEY, "day").agg(F.sum("lines").alias("lines"), F.sum("events").alias("events"))
    w = W.partitionBy(*KEY).orderBy("day")
    days = days.select("*", F.sum("events").over(w).alias("seen"), F.coalesce(F.sum("events").over(w.rangeBetween(W.unboundedPreceding, -window_days - 1)), zero).alias("old"), (F.col("day") - F.lag("day").over(w) > window_days).cast("int").alias("apart"))
    days = days.withColumn("stretch", F.sum(F.coalesce("apart", F.lit(0))).over(w))
    runs = days.groupBy(*KEY, "stretch").agg(F.array_sort(F.collect_list(_struct(day=F.col("day"), lines=F.col("lines"), events=F.col("events"), seen=F.col("seen"), old=F.col("old")))).alias("days"))

    def forward(done: Column, d: Column) -> Column:
        left = F.greatest(done["gone"], d["old"])
        served = F.least(d["lines"], d["seen"] - left)
        own = _struct(before=done["gone"], after=left + served, matched=served)
        return F.struct((left + served).cast("long").alias("gone"), F.concat(done["all"], F.array(own)).alias("all"))

    def backward(done: Column, d: Column) -> Column:
        earlier = F.greatest(F.least(done["slack"], d["seen"]) - d["lines"], d["old"])
        return F.struct(earlier.cast("long").alias("slack"), F.concat(F.array(done["slack"]), done["all"]).alias("all"))

    none = F.array().cast("array<struct<before:bigint,after:bigint,matched:bigint>>")
    gone = F.aggregate("days", F.struct(zero.alias("gone"), none.alias("all")), forward)["all"]
    slack = F.aggregate(F.reverse("days"), F.struct(F.lit(_ALL).cast("long").alias("slack"), F.array().cast("array<bigint>").alias("all")), backward)["all"]
    each = runs.select(*KEY, "stretch", F.explode(F.arrays_zip(F.col("days").alias("d"), gone.alias("g"), slack.alias("slack"))).alias("x"))
    return each.select(*KEY, "stretch", "x.d.*", "x.g.*", "x.slack")


def largest(pairs: DataFrame, window_days: int) -> DataFrame:
    """(amount_paise, currency, n_matched): the size of a largest assignment."""
    return sweeps(pairs, window_days).groupBy(*KEY).agg(F.sum("matched").alias("n_matched"))


def feasible(pairs: DataFrame, window_days: int) -> DataFrame:
    """pairs with `feasible`: whether some largest assignment pairs a line and an event of these days."""
    w = W.partitionBy(*KEY, "stretch").orderBy("day").rangeBetween(0, window_days)
    near = F.collect_list(F.struct("day", "lines", "seen", "old", "after", "matched", "slack")).over(w)
    events = sweeps(pairs, window_days).select(*KEY, "stretch", "day", "events", "before", near.alias("near")).where("events > 0")
    each = events.select(*KEY, F.col("day").alias("made"), "before", "near", F.explode(F.filter("near", lambda d: d["lines"] > 0)).alias("to"))

    def forced(done: Column, d: Column) -> Column:
        left = F.greatest(done["gone"], d["old"])
        served = F.least(d["lines"] - (d["day"] == F.col("to.day")).cast("long"), d["seen"] - 1 - left)
        return _struct(gone=left + served, matched=done["matched"] + served)

    last = F.element_at("near", -1)
    lost = lambda gone: F.greatest(gone - last["slack"], F.lit(0))
    served = F.aggregate("near", F.lit(0).cast("long"), lambda n, d: n + d["matched"]) - lost(last["after"])
    again = F.aggregate("near", _struct(gone=F.col("before"), matched=F.lit(0)), forced)
    each = each.select(*KEY, F.date_from_unix_date(F.col("to.day").cast("int")).alias("settled_on"), F.date_from_unix_date(F.col("made").cast("int")).alias("created_on"), again.alias("again"), served.alias("served"), last.alias("last"))
    verdict = F.col("again.matched") + 1 - F.greatest(F.col("again.gone") + 1 - F.col("last.slack"), F.lit(0)) == F.col("served")
    return pairs.join(each.select(*PAIR, verdict.alias("feasible")), list(PAIR))
