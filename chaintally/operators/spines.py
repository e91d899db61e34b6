"""Calendars and dense frames, built by expanding rows rather than by joining them."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W


def first_day(df, column="date"):
    """Earliest day of a frame as a scalar usable inside any expression."""
    return df.agg(F.min(F.to_date(column)).alias("first_day")).scalar()


def _days(start, stop):
    return F.when(start <= stop, F.sequence(start, stop))


def date_spine(df, column, as_of):
    """Every day from the first event to ``as_of``."""
    bounds = df.agg(F.min(F.to_date(column)).alias("lo"))
    return bounds.select(F.explode(_days(F.col("lo"), as_of)).alias("date"))


def key_spine(df, columns):
    """Distinct keys."""
    return df.select(*columns).distinct()


def address_spine(transfers, from_col="from_address", to_col="to_address"):
    """Every address that ever sent or received (T11), from one pass over the transfers."""
    return (transfers.select(F.explode(F.array(from_col, to_col)).alias("address"))
            .filter(F.col("address").isNotNull()).distinct())


def dense_frame(keys, start, as_of):
    """One row per key and day (T12): each key row expands in place, nothing is joined."""
    return keys.select(F.explode(_days(start, as_of)).alias("date"), *keys.columns)


def fill_days(series, as_of, carry=(), on_day=(), absent=None, by=()):
    """Make a day-grain series dense up to ``as_of``.

    Every row expands over the days until the next one. ``carry`` columns repeat, ``on_day``
    columns hold only on their own day and take ``absent[c]`` (NULL by default) on the days
    filled in. The series has one row per calendar day (and ``by`` value), so ordering it in
    one task is bounded by the calendar and not by the data.
    """
    absent = absent or {}
    w = W.partitionBy(*by).orderBy("date") if by else W.orderBy("date")
    stop = F.coalesce(F.date_sub(F.lead("date").over(w), 1), as_of)
    spread = (series.filter(F.col("date") <= as_of)
              .withColumn("_stop", stop)
              .withColumn("_day", F.explode(F.sequence("date", "_stop"))))
    own = F.col("_day") == F.col("date")
    return spread.select(
        F.col("_day").alias("date"), *by, *carry,
        *[F.when(own, F.col(c)).otherwise(F.lit(absent.get(c))).alias(c) for c in on_day])
