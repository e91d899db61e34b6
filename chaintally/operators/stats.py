"""Summaries of holders, trades and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from chaintally.constants import CONFIDENCE_Z, DEAD_ADDRESS, SINK_ADDRESSES, ZERO_ADDRESS
from chaintally.functions import wide
from chaintally.functions.columns import as_col, not_sink, ratio, zero_if_null


def avg_purchase_price(flows, close, decimals):
    """What each address paid on average for the tokens it received.

    ``flows`` are labelled legs per (date, address); summing per day before valuing keeps
    the price join small. Days without a price count tokens but no value.
    """
    unit = F.pow(F.lit(10.0), as_col(decimals))
    buys, number = F.col("transfer_type") == "buy", wide.of(flows, "transfer_amount")
    daily = number.settled(flows.groupBy("date", "address").agg(
        number.total("transfer_amount").alias("net"),
        number.total(F.when(buys, F.col("transfer_amount"))).alias("bought")), "net", "bought")
    valued = daily.join(close.select("date", "close_price"), "date", "left")
    per = number.settled(valued.groupBy("address").agg(
        number.total("net").alias("_net"), number.total("bought").alias("_bought"),
        F.sum(number.double("bought") / unit * F.col("close_price")).alias("_paid")), "_net", "_bought")
    return per.select("address", (number.double("_net") / unit).alias("balance_token"),
                      F.try_divide(F.col("_paid"), number.double("_bought") / unit).alias("avg_purchase_price_usd"))


#: Sizes to a piece of the holdings distribution.
PIECE = 100_000


def segment_counts(wide, rules, part="date", key="address"):
    """Addresses per ``part`` that meet each rule (T33); ``rules`` maps a name to a condition."""
    return wide.groupBy(part).agg(*[
        F.count_distinct(F.when(rule, F.col(key))).alias(name) for name, rule in rules.items()])


def holdings_distribution(balances, measure="nfts_cnt", key="address", include_nonpositive=False):
    """How many addresses hold each number of items, with cumulative counts and shares.

    Rows are folded to one per holding size before anything is ordered. With N items in all
    there are at most about sqrt(2 N) different positive sizes, so that order is small.
    Sizes nobody holds are filled in by expanding each size up to the next, in pieces that
    many tasks share.
    """
    sizes = (balances.groupBy(F.col(measure).cast("long").alias("size"))
             .agg(F.count(key).alias("cnt")))
    counted = F.when(F.col("size") > 0, F.col("cnt")).otherwise(F.lit(0).cast("long"))
    w = W.orderBy("size")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    total = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    items = F.col("size") * F.col("cnt")
    summed = sizes.select("size", counted.alias("cnt")).select(
        "size", "cnt", F.coalesce(F.lead("size").over(w) - 1, "size").alias("_stop"),
        F.sum(items).over(upto).alias("cum_items"), F.sum("cnt").over(upto).alias("cum_addresses"),
        F.sum(items).over(total).alias("all_items"), F.sum("cnt").over(total).alias("all_addresses"))
    lo = F.col("size") if include_nonpositive else F.greatest("size", F.lit(1).cast("long"))
    # A wide gap becomes pieces first, and the pieces are spread before they become rows.
    pieces = F.when(lo <= F.col("_stop"), F.sequence(lo, F.col("_stop"), F.lit(PIECE)))
    cut = summed.withColumn("_from", F.explode(pieces)).repartition("_from")
    filled = cut.withColumn("nfts_cnt", F.explode(F.sequence("_from", F.least("_stop", F.col("_from") + (PIECE - 1)))))
    own = F.col("nfts_cnt") == F.col("size")
    return filled.select(
        "nfts_cnt", F.when(own, F.col("cnt")).otherwise(0).alias("address_cnt"),
        F.col("cum_items").alias("cum_nfts_cnt"), F.col("cum_addresses").alias("cum_address_cnt"),
        ratio("cum_items", "all_items").alias("cum_nfts_share"),
        ratio("cum_addresses", "all_addresses").alias("cum_address_share"))


def confidence_band(df, measure, z=CONFIDENCE_Z):
    """Mean plus and minus ``z`` standard errors over all rows, and who lies inside."""
    half = F.lit(z) * F.stddev_samp(measure) / F.sqrt(F.count(measure))
    band = df.agg(F.struct((F.avg(measure) - half).alias("lower"),
                           (F.avg(measure) + half).alias("upper")).alias("band")).scalar()
    inside = (F.col("confidence_lower") <= F.col(measure)) & (
        F.col(measure) <= F.col("confidence_upper"))
    return (df.withColumn("_band", band)
            .withColumn("confidence_lower", F.col("_band.lower"))
            .withColumn("confidence_upper", F.col("_band.upper")).drop("_band")
            .withColumn("confidence_group", F.when(inside, "Normal").otherwise("Abnormal")))


def trade_measures(trades, keys, addresses=True, negate_sell=False):
    """Distinct addresses and transactions, token and USD volume of buys and of sells.

    Grouping by direction first leaves two distinct counts instead of four, so rows are
    tripled, not quintupled, before the map-side combine; the pivot then sees two rows per
    key. Distinct counts group by the counted value first, which spreads heavy keys.
    """
    aggs = [F.count_distinct("tx_hash").alias("txs_cnt"),
            F.sum("amount_token").alias("tx_volume_token"),
            F.sum("amount_usd").alias("tx_volume_usd")]
    if addresses:
        aggs.insert(0, F.count_distinct("address").alias("addresses_cnt"))
    measures = (["addresses_cnt"] if addresses else []) + ["txs_cnt", "tx_volume_token", "tx_volume_usd"]
    sided = trades.groupBy(*keys, "trade_type").agg(*aggs)
    out = []
    for m in measures:
        for side in ("buy", "sell"):
            value = F.max(F.when(F.col("trade_type") == side, F.col(m)))
            if m.endswith("_cnt"):
                value = zero_if_null(value)
            if negate_sell and side == "sell":
                value = value * -1
            out.append(value.alias(f"{m}_{side}"))
    return sided.groupBy(*keys).agg(*out)


def current_balance(holders, totals, plus, minus, on="address", out="balance", positive=False):
    """What holders own now, from per-address totals that may be missing.

    ``totals`` is grouped by the join key already, so the join adds no shuffle on its side,
    and an address with very many events arrives as a single row.
    """
    joined = holders.join(totals, on, "left")
    number = wide.of(joined, plus)
    joined = joined.withColumn(out, number.or_zero(plus))
    for m in minus:
        joined = number.settled(joined.withColumn(out, number.minus(out, number.or_zero(m))), out)
    return joined.filter(number.above_zero(out)) if positive else joined


def supply_mint_burn(balance, measure="balance", keys=("date",)):
    """Circulating supply, minted and burnt amounts per day.

    The zero address runs negative as it mints, so mint is positive and burn negative.
    """
    number = wide.of(balance, measure)
    b, address = number.or_zero(measure), F.col("address")
    split = number.settled(balance.groupBy(*keys).agg(
        number.total(F.when(not_sink(address, SINK_ADDRESSES), b)).alias("total_supply"),
        number.total(F.when(address == ZERO_ADDRESS, number.negative(b))).alias("total_mint"),
        number.total(F.when(address == DEAD_ADDRESS, number.negative(b))).alias("total_burn")),
        "total_supply", "total_mint", "total_burn")
    return split


def contract_profile(contracts, transfers, address):
    """Registry entry of a contract with the standard its transfers reveal.

    ``transfers`` maps a standard to the tables that would hold its transfers, in order of
    precedence. Only existence matters. A table may be given as a function that says whether it
    holds a contract, such as ``ZoneIndex.holds``, which opens the few files that can; a plain
    table is scanned, each task up to its first row.
    """
    kind = F.lit("Unknown")
    for standard, tables in reversed(list(transfers.items())):
        found = F.lit(False)
        for df in tables:
            if callable(df):
                found = found | F.lit(df(address))
                continue
            hit = df.filter(F.col("contract_address") == address).limit(1)
            found = found | (hit.agg(F.count(F.lit(1)).alias("n")).scalar() > 0)
        kind = F.when(found, standard).otherwise(kind)
    return (contracts.filter(F.col("address") == address)
            .select(F.col("name").alias("project"), F.col("namespace").alias("contract_name"),
                    kind.alias("contract_type"), F.col("from").alias("deployer"))
            .orderBy(F.col("project").asc_nulls_last(), F.col("contract_name").asc_nulls_last(),
                     F.col("deployer").asc_nulls_last())
            .limit(1))
