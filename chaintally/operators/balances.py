"""Running balances, dense where rows per day are wanted and sparse where they are not.

A balance changes only on days with a flow. ``active_balances`` keeps just those days, so
its size follows the flows. Daily figures over all addresses (holder counts, supply,
concentration) are running sums of the changes on active days; only reports that list every
address on every day pay for the dense frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F, Window as W

from chaintally.functions import wide
from chaintally.operators.ranking import top_ranks
from chaintally.operators.spines import fill_days


def active_balances(net, keys=("address",), measures=("net_amount",), out=None):
    """Balance after and before each active day, and the next active day of the same key.

    ``net`` has one row per key and day, which bounds every window partition by the calendar.
    """
    out = out or {m: "balance" for m in measures}
    w = W.partitionBy(*keys).orderBy("date")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    cols = []
    for m in measures:
        number = wide.of(net, m)
        cols += [number.total(number.or_zero(m), upto).alias(out[m]),
                 number.total(number.or_zero(m), before).alias(f"prev_{out[m]}")]
    active = net.select("date", *keys, *cols, F.lead("date").over(w).alias("next_date"))
    for m in measures:
        number = wide.of(net, m)
        active = number.settled(active, out[m], f"prev_{out[m]}")
        active = active.withColumn(f"prev_{out[m]}", number.or_zero(f"prev_{out[m]}"))
    return active


def balance_spans(net, start, as_of, keys=("address",), measure="net_amount", out="balance"):
    """Days ``lo`` to ``hi`` over which each key's balance stands still, from ``start`` on.

    The span before the first active day holds zero. Spans of a key cover the calendar
    without overlap, and there are at most as many as active days plus one.
    """
    active = active_balances(net, keys, [measure], {measure: out}).filter(F.col("date") <= as_of)
    opening = F.lag("date").over(W.partitionBy(*keys).orderBy("date")).isNull()
    held = F.struct(F.col("date").alias("lo"), _last_day(as_of).alias("hi"), F.col(out))
    before = F.struct(start.alias("lo"), F.date_sub("date", 1).alias("hi"),
                      F.col(f"prev_{out}").alias(out))
    spans = F.when(opening, F.array(before, held)).otherwise(F.array(held))
    return active.select(*keys, spans.alias("_spans")).select(*keys, F.inline("_spans")).filter(
        F.col("lo") <= F.col("hi"))


def _last_day(as_of):
    return F.least(F.coalesce(F.date_sub("next_date", 1), as_of), as_of)


def running_balance(net, start, as_of, keys=("address",), measures=("net_amount",), out=None,
                    gaps="carry", before_first=0):
    """Balance per key on every day from ``start`` to ``as_of``.

    Each active day expands until the day before the next one; the first active day of a key
    also emits the days before it, holding ``before_first``. No frame is joined, so only the
    flows are shuffled. ``gaps='sparse'`` leaves days without a flow NULL.
    """
    out = out or {m: "balance" for m in measures}
    names = [out[m] for m in measures]
    active = active_balances(net, keys, measures, out).filter(F.col("date") <= as_of)
    opening = F.lag("date").over(W.partitionBy(*keys).orderBy("date")).isNull()
    lo = F.when(opening, F.least(start, F.col("date"))).otherwise(F.col("date"))
    spread = active.withColumn("_lo", lo).withColumn(
        "_day", F.explode(F.sequence("_lo", _last_day(as_of))))
    shown = F.col("_day") >= F.col("date")
    if gaps == "sparse":
        shown, before_first = F.col("_day") == F.col("date"), None

    def opening_of(n):
        return wide.of(spread, n).zero if before_first == 0 else F.lit(before_first)

    return spread.select(F.col("_day").alias("date"), *keys, *[
        F.when(shown, F.col(n)).otherwise(opening_of(n)).alias(n) for n in names])


def top_balances(net, start, as_of, n, key="address", measure="net_amount", out="balance",
                 block=32, leaders=1000):
    """The (day, key) rows of positive balance that can be among the ``n`` largest of a day.

    Balances of zero and below are never expanded: ``sign_counts`` tells how many there are.

    Within a block of days the n-th largest of some keys' lowest balances is a floor: at
    least n keys stay on or above it all the time, whichever keys are looked at. A balance
    below its block's floor is therefore never among the n largest, and only the others are
    expanded to days. Floors are taken from ``leaders``, the keys that hold or ever received
    the most, so that the whole ledger is ordered only once. The choice of leaders decides
    how many rows are expanded, never the result: equal balances are kept, and a block that
    fewer than n leaders cover has no floor.
    """
    first = F.lit("1970-01-01").cast("date")

    def by_block(spans):
        def number(day):
            return F.floor(F.datediff(day, first) / block).cast("int")

        return spans.withColumn("_block", F.explode(F.sequence(number(F.col("lo")), number(F.col("hi")))))

    number = wide.of(net, measure)
    reach = number.settled(net.groupBy(key).agg(
        number.total(measure).alias("_now"),
        number.total(F.greatest(F.col(measure), number.zero)).alias("_received")), "_now", "_received")
    lead = reduce(lambda x, y: x.union(y), [
        reach.orderBy(F.col(c).desc_nulls_last(), key).limit(max(leaders, n)).select(key)
        for c in ("_now", "_received")]).distinct()
    led = net.join(F.broadcast(lead), key, "left_semi")
    lowest = (by_block(balance_spans(led, start, as_of, (key,), measure, out))
              .groupBy(key, "_block").agg(F.min(out).alias("_low")))
    floors = (top_ranks(lowest, "_low", "_block", key, n).groupBy("_block")
              .agg(F.min("_low").alias("_floor"), F.count(F.lit(1)).alias("_keys"))
              .filter(F.col("_keys") == n).select("_block", "_floor"))
    # One row per block of the calendar.
    held = balance_spans(net, start, as_of, (key,), measure, out).filter(number.above_zero(out))
    near = by_block(held).join(
        F.broadcast(floors), "_block", "left").filter(
        F.col("_floor").isNull() | (F.col(out) >= F.col("_floor")))
    opens = F.date_add(first, F.col("_block") * block)
    day = F.explode(F.sequence(F.greatest("lo", opens), F.least("hi", F.date_add(opens, block - 1))))
    return near.select(day.alias("date"), key, out)


def sign_counts(net, as_of, key="address", measure="net_amount"):
    """Number of keys above (``_above``) and below zero (``_below``) per day, from active days only."""
    number = wide.of(net, measure)

    def step(side):
        return side("balance").cast("long") - side("prev_balance").cast("long")

    changes = active_balances(net, (key,), (measure,)).select(
        "date", step(number.above_zero).alias("_above"), step(number.below_zero).alias("_below"))
    return daily_totals(changes, as_of, ["_above", "_below"])


def lowest_balances(net, start, as_of, days, n, key="address", measure="net_amount", out="balance"):
    """The largest balances below zero on the few ``days (date, _nonnegative)`` that need them.

    On those days fewer than ``n`` keys stand at zero or above; ranks follow theirs.
    """
    debts = balance_spans(net, start, as_of, (key,), measure, out).filter(wide.of(net, measure).below_zero(out))
    # one list with at most one entry per calendar day
    poor = days.agg(F.collect_list(F.struct("date", "_nonnegative")).alias("d")).scalar()
    mine = F.filter("_poor", lambda d: d["date"].between(F.col("lo"), F.col("hi")))
    rows = debts.withColumn("_poor", poor).select(key, out, F.inline(mine))
    return top_ranks(rows, out, key=key, n=n).withColumn(
        "rank", (F.col("rank") + F.col("_nonnegative")).cast("int")).filter(
        F.col("rank") <= n).select("date", key, out, "rank")


def daily_totals(changes, as_of, measures, null_if_never=()):
    """Running total per day of changes that happened on active days.

    ``changes`` carries one delta per measure and row. Partial sums per day come first; what
    is ordered in one task has one row per calendar day. Measures in ``null_if_never`` are
    NULL throughout when no row ever contributed to them, and zero until the first one did.
    """
    numbers = {m: wide.of(changes, m) for m in measures}
    per_day = changes.groupBy("date").agg(*[numbers[m].total(m).alias(m) for m in measures])
    per_day = reduce(lambda df, m: numbers[m].settled(df, m), measures, per_day)
    w = W.orderBy("date")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    ever = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    totals = per_day.select("date", *[numbers[m].total(m, upto).alias(m) for m in measures], *[
        (F.count(m).over(ever) > 0).alias(f"_ever_{m}") for m in null_if_never])
    totals = reduce(lambda df, m: numbers[m].settled(df, m), measures, totals).withColumns({
        m: F.when(F.col(f"_ever_{m}"), numbers[m].or_zero(m)) for m in null_if_never})
    return fill_days(totals, as_of, carry=measures)


def current_totals(flows, keys=("address",), amount="transfer_amount", out="balance"):
    """Latest balance per key: the plain sum of its flows, no calendar needed."""
    number = wide.of(flows, amount)
    return number.settled(flows.groupBy(*keys).agg(number.total(amount).alias(out)), out)
