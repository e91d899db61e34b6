"""Who was active, who arrived and who left."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from chaintally.functions import wide
from chaintally.operators.spines import fill_days

PERIODS = {"day": lambda c: c, "week": lambda c: F.trunc(c, "week"),
           "month": lambda c: F.trunc(c, "month")}


def _before(period, column):
    """First day of the period before the one starting at ``column``."""
    return {"day": F.date_sub(column, 1), "week": F.date_sub(column, 7),
            "month": F.add_months(column, -1).cast("date")}[period]


def rolling_distinct(df, keys, windows, as_of, date="date"):
    """Distinct keys seen in trailing windows, for every day.

    ``keys`` maps an output suffix to a key column, ``windows`` an output prefix to a number
    of days. A key seen on day d counts from d until its window ends or it is seen again,
    whichever is first; those spans never overlap, so each sighting contributes +1 at its
    start and -1 at its end and a running sum over days gives exact counts. Every window and
    every key column comes out of one pass with one shuffle by key and one by day, and the
    sightings are never multiplied by the window length.
    """
    roles = [F.struct(F.lit(suffix).alias("role"), F.col(column).alias("key"))
             for suffix, column in keys.items()]
    seen = df.select(F.to_date(date).alias("date"), F.inline(F.array(*roles))).distinct()
    again = F.lead("date").over(W.partitionBy("role", "key").orderBy("date"))
    weight = F.when(F.col("key").isNotNull(), 1).otherwise(0)
    seen = seen.select("date", "role", weight.alias("n"), again.alias("again"))

    def edge(day, prefix, sign):
        return F.struct(day.alias("date"), F.col("role"), F.lit(prefix).alias("name"),
                        (F.col("n") * sign).alias("delta"))

    edges = []
    for prefix, days in windows.items():
        end = F.least(F.date_add("date", days), F.coalesce("again", F.date_add("date", days)))
        edges += [edge(F.col("date"), prefix, 1), edge(end, prefix, -1)]
    moves = seen.select(F.inline(F.array(*edges)))
    columns = [(p, s, f"{p}_{s}" if s else p) for p in windows for s in keys]
    per_day = moves.groupBy("date").agg(*[
        F.sum(F.when((F.col("name") == p) & (F.col("role") == s), F.col("delta")).otherwise(0))
        .alias(c) for p, s, c in columns])
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    names = [c for _, _, c in columns]
    totals = per_day.select("date", *[F.sum(c).over(w).alias(c) for c in names])
    return fill_days(totals, as_of, carry=names)


def cumulative_distinct(df, key, as_of, date="date", daily="dau", out="cumulative_dau"):
    """Distinct keys per day and distinct keys ever seen up to that day.

    Only the first sighting of a key moves the cumulative count.
    """
    seen = df.select(F.to_date(date).alias("date"), F.col(key).alias("key")).distinct()
    first = F.lag("date").over(W.partitionBy("key").orderBy("date")).isNull()
    known = F.col("key").isNotNull()
    per_day = (seen.select("date", known.cast("long").alias("n"),
                           (known & first).cast("long").alias("new"))
               .groupBy("date").agg(F.sum("n").alias(daily), F.sum("new").alias("new")))
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = per_day.select("date", daily, F.sum("new").over(w).alias(out))
    return fill_days(totals, as_of, carry=[out], on_day=[daily], absent={daily: 0}).select(
        "date", daily, out)


def lag_delta(df, measure, lags, order="date", by=(), sign_of=None, sign_out="group"):
    """Difference to earlier rows of a day-grain series.

    ``lags`` maps an output name to a number of rows. ``sign_of`` names one of the outputs to
    label: 'positive' above zero, otherwise (also without an earlier row) 'negative'.
    """
    w = W.partitionBy(*by).orderBy(order) if by else W.orderBy(order)
    df = df.select("*", *[(F.col(measure) - F.lag(measure, n).over(w)).alias(name)
                          for name, n in lags.items()])
    if sign_of:
        df = df.withColumn(sign_out, F.when(F.col(sign_of) > 0, "positive").otherwise("negative"))
    return df


def holder_transitions(balance, measure="balance"):
    """Holders that appear and disappear per day, from a dense balance.

    The first row of an address has nothing before it and is no event.
    """
    before = F.lag(measure).over(W.partitionBy("address").orderBy("date"))
    return _count_transitions(balance.select("date", F.col(measure).alias("now"),
                                             before.alias("before")))


def _count_transitions(moves):
    came = (F.col("before") == 0) & (F.col("now") > 0)
    left = (F.col("before") > 0) & (F.col("now") == 0)
    return moves.groupBy("date").agg(
        F.count(F.when(came, 1)).alias("holders_in_cnt"),
        (F.count(F.when(left, 1)) * -1).alias("holders_out_cnt"))


def transitions_from_active(active, as_of, measure="balance"):
    """The same counts as :func:`holder_transitions` from active days only.

    Balances stand still between active days, so nothing else can be an event. The first
    day of the calendar has no day before it and therefore no events.
    """
    counts = _count_transitions(active.select(
        "date", F.col(measure).alias("now"), F.col(f"prev_{measure}").alias("before")))
    names = ["holders_in_cnt", "holders_out_cnt"]
    opening = F.lag("date").over(W.orderBy("date")).isNull()
    counts = counts.select("date", *[F.when(opening, 0).otherwise(F.col(c)).alias(c) for c in names])
    return fill_days(counts, as_of, on_day=names, absent=dict.fromkeys(names, 0))


def new_holders(balance, period="day", out="new_cnt", measure="balance", first_time_only=False):
    """Addresses that hold in a period and did not in the one before (T31), dense form."""
    holding = F.sum(F.when(wide.of(balance, measure).above_zero(measure), 1).otherwise(0))
    per = (balance.groupBy(PERIODS[period](F.col("date")).alias(period), "address")
           .agg(holding.alias("days")))
    w = W.partitionBy("address").orderBy(period)
    if first_time_only:
        earlier = F.sum("days").over(w.rowsBetween(W.unboundedPreceding, -1))
        per = per.withColumn("before", F.coalesce(earlier, F.lit(0)))
    else:
        per = per.withColumn("before", F.lag("days", 1, 0).over(w))
    return (per.filter((F.col("before") == 0) & (F.col("days") > 0))
            .groupBy(period).agg(F.count("address").alias(out)))


def new_holders_from_active(active, as_of, period="day", out="new_cnt", measure="balance",
                            first_time_only=False):
    """:func:`new_holders` for carried balances, from active days only.

    An active day with a positive balance starts a holding span that lasts until the day
    before the next active day. A period is new when it contains the start of a span and no
    earlier span reaches it or the period before it.
    """
    start = PERIODS[period](F.col("date"))
    stop = PERIODS[period](F.coalesce(F.date_sub("next_date", 1), as_of))
    spans = (active.filter(wide.of(active, measure).above_zero(measure))
             .select("address", "date", start.alias(period), stop.alias("_until")))
    reached = F.lag("_until").over(W.partitionBy("address").orderBy("date"))
    fresh = reached.isNull()
    if not first_time_only:
        fresh = fresh | (reached < _before(period, F.col(period)))
    return (spans.withColumn("_new", fresh).filter("_new")
            .groupBy(period).agg(F.count("address").alias(out)))
