"""Price series: closes, latest prices, valuation, averages and gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from chaintally.functions.columns import as_col
from chaintally.operators.flows import fits_broadcast
from chaintally.session import materialise


def _tick():
    """Order of ticks: by time, and of two in one minute the higher price counts."""
    return F.struct("minute", "price")


def daily_close(prices, by=("contract_address",), labels=()):
    """Last price of every day (T14): one hash aggregate, no sort of the ticks.

    ``labels`` are further columns taken from the same last tick. Ticks are first folded per
    label, with numbers only in the aggregate, so that text is compared on days, not ticks.
    """
    day = F.to_date("minute").alias("date")
    if not labels:
        return prices.groupBy(*by, day).agg(F.max_by("price", _tick()).alias("close_price"))
    folded = prices.groupBy(*by, *labels, day).agg(
        F.max_by("price", _tick()).alias("close_price"), F.max(_tick()).alias("_at"))
    return folded.groupBy(*by, "date").agg(*[
        F.max_by(c, "_at").alias(c) for c in ("close_price", *labels)])


def latest_price(prices, by=("contract_address",), out="last_price", ignore_nulls=True):
    """Most recent price per contract, or over all ticks when ``by`` is empty."""
    if ignore_nulls:
        prices = prices.filter(F.col("price").isNotNull())
    return prices.groupBy(*by).agg(F.max_by("price", _tick()).alias(out))


def attach_usd(df, price, on=("date",), amount="balance_token", out="balance_usd",
               price_column="close_price", drop_unpriced=False):
    """Value an amount at the price of its day.

    Rows without a price stay with a NULL value unless ``drop_unpriced``. Prices are counted
    and broadcast while few, so that a day of a leading contract is not shuffled into one task.
    """
    price = materialise(price)
    if fits_broadcast(price):
        price = F.broadcast(price)
    return (df.join(price, list(on), "inner" if drop_unpriced else "left")
            .withColumn(out, F.col(amount) * F.col(price_column)).drop(price_column))


def attach_as_of(df, ticks, by="contract_address", at="evt_block_time", out="last_price", block=3600):
    """The latest price of a contract at or before the time ``at`` of each row (T16 by the minute).

    Rows and ticks meet in one sorted stream per contract and block of ``block`` seconds, where
    the price is the last tick above. What a block starts with is the last tick of any block
    before, carried by a running value over one row per contract and block; it enters the stream
    as its first row. So a contract with a third of all rows is spread over the blocks of time.
    Of two ticks at one time the higher price counts. Rows without a tick before them, a contract or a time get NULL.
    """
    def number(column):
        return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / (block * 1_000_000)).cast("long")

    known = ticks.filter(F.col(by).isNotNull() & F.col("price").isNotNull() & F.col("minute").isNotNull()).select(
        F.col(by).alias("_by"), number("minute").alias("_block"), F.col("minute").alias("_at"), F.col("price").alias("_price"))
    events = df.select(F.col(by).alias("_by"), number(at).alias("_block"), F.col(at).alias("_at"), F.struct(*df.columns).alias("_row"))
    last = known.groupBy("_by", "_block").agg(F.max_by("_price", F.struct("_at", "_price")).alias("_last"))
    asked = events.select("_by", "_block", F.lit(True).alias("_asked")).distinct()
    before = W.partitionBy("_by").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.join(asked, ["_by", "_block"], "full").withColumn(
        "_price", F.last("_last", ignorenulls=True).over(before)).filter("_asked AND _price IS NOT NULL")
    stream = events.withColumn("_kind", F.lit(2)).unionByName(
        known.withColumn("_kind", F.lit(1)), allowMissingColumns=True).unionByName(
        carried.select("_by", "_block", "_price", F.lit(0).alias("_kind")), allowMissingColumns=True)
    above = W.partitionBy("_by", "_block").orderBy(F.col("_at").asc_nulls_first(), "_kind", F.col("_price").asc_nulls_first())
    priced = stream.withColumn(out, F.last("_price", ignorenulls=True).over(above.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return priced.filter("_kind = 2").select("_row.*", out)


def moving_average(df, value, windows, order="date", by=(), exact=False):
    """Trailing means of a day-grain series.

    ``windows`` maps an output name to n. A window averages the row and the n rows before
    it, so n + 1 rows, which is how the published series are defined; ``exact`` takes n.
    """
    w = W.partitionBy(*by).orderBy(order) if by else W.orderBy(order)
    return df.select("*", *[
        F.avg(value).over(w.rowsBetween(-(n - 1 if exact else n), W.currentRow)).alias(name)
        for name, n in windows.items()])


def forward_fill(df, columns, order="date", by=()):
    """Replace NULL by the latest earlier value of a day-grain series."""
    w = W.partitionBy(*by).orderBy(order) if by else W.orderBy(order)
    w = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.select(*[
        F.last(c, ignorenulls=True).over(w).alias(c) if c in columns else as_col(c)
        for c in df.columns])
