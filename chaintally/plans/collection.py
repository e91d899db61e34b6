"""Reports about one collection of items: holders, concentration, cohorts and the market."""

from __future__ import annotations

from pyspark.sql import functions as F

from chaintally.constants import (
    ADDRESS_PAGE, HHI_LINES, NFT_PAGE, SINK_ADDRESSES, WEI_DECIMALS, ZERO_ADDRESS)
from chaintally.functions import wide
from chaintally.functions.columns import explorer_link, not_sink, ratio, scaled
from chaintally.operators import activity, balances, flows, prices, ranking, spines, stats
from chaintally.plans.token import native_totals
from chaintally.session import materialise


# --- shared pieces -----------------------------------------------------------------------

def _legs(src, collections, keys=()):
    """Items received and given away per address; a row without a hash moves nothing."""
    names = [collections] if isinstance(collections, str) else list(collections)
    rows = src.table("erc721_transfers").filter(F.col("contract_address").isin(*names))
    return _item_flows(rows, keys)


def _item_flows(rows, keys=(), label=False):
    items = rows.select(
        F.to_date("evt_block_time").alias("date"), "contract_address",
        F.col("from").alias("from_address"), F.col("to").alias("to_address"),
        F.col("evt_tx_hash").isNotNull().cast("long").alias("items"))
    return flows.signed_flows(items, "items", keys=keys, pre_aggregate=False, label=label)


def _active(src, collection):
    """Balances on active days. Sinks keep their days, because they belong to the calendar."""
    active = balances.active_balances(flows.net_flows(_legs(src, collection)))
    own = not_sink("address")
    return active.select("date", "address", "next_date", *[
        F.when(own, F.col(c)).otherwise(0).alias(c) for c in ("balance", "prev_balance")])


def daily_balance(src, collection):
    """Items of every address on every day: the dense form behind R47 to R49."""
    net = materialise(flows.net_flows(_legs(src, collection)))
    return flows.exclude_addresses(
        balances.running_balance(net, spines.first_day(net), src.today))


def collection_holders(src, collection):
    """Addresses that own at least one item now."""
    totals = balances.current_totals(_legs(src, collection))
    return flows.exclude_addresses(totals.filter(F.col("balance") > 0)).select("address")


# --- cohorts -----------------------------------------------------------------------------

def _latest_quote(src, contract, symbol):
    ticks = src.table("prices_usd").filter(F.col("contract_address") == contract)
    if symbol is not None:
        ticks = ticks.filter(F.lower("symbol") == symbol.lower())
    return prices.latest_price(ticks, by=()).select("last_price").scalar()


def cohort_token_class(src, collection, token, scale=WEI_DECIMALS, symbol=None):
    """Wealth bands of the collection's holders by how much of ``token`` they own."""
    moved = wide.amounts(src.table("erc20_transfers").filter(F.col("contract_address") == token).select(
        F.to_date("evt_block_time").alias("date"), F.col("from").alias("from_address"),
        F.col("to").alias("to_address"), "value"), "value")
    people = materialise(collection_holders(src, collection))
    number = wide.of(moved, "value")
    legs = flows.narrow_to(flows.signed_flows(
        moved.filter(number.above_zero("value")), "value", pre_aggregate=False), "address", people, src.broadcast_rows)
    owned = stats.current_balance(people, balances.current_totals(legs, out="raw"), "raw", [])
    valued = owned.withColumn("token_balance", F.round(number.units("balance", scale), 8)).withColumn(
        "token_balance_usd", F.col("token_balance") * _latest_quote(src, token, symbol))
    bands = ranking.percentile_class(
        valued, "token_balance", "token_balance_usd",
        names=("token_balance_usd_min", "token_balance_usd_max", "address_cnt"))
    return bands.orderBy(ranking.ascending("token_balance_usd_min"),
                         ranking.ascending("token_balance_usd_max"))


def cohort_eth_class(src, collection, quote, symbol=None):
    """Wealth bands of the collection's holders by native coin.

    ``quote`` is the contract whose price stands for the native coin.
    """
    people = materialise(collection_holders(src, collection))
    owned = stats.current_balance(people, native_totals(src, people), "wei_in", ["wei_out", "wei_gas"], out="wei")
    exact = scaled(F.round("wei", 8 - WEI_DECIMALS), WEI_DECIMALS)
    valued = owned.withColumn("eth_balance", exact).withColumn(
        "eth_balance_usd", F.col("eth_balance") * _latest_quote(src, quote, symbol))
    bands = ranking.percentile_class(
        valued, "eth_balance", "eth_balance_usd",
        names=("eth_balance_usd_min", "eth_balance_usd_max", "address_cnt"))
    return bands.select("class", "address_cnt", "eth_balance_usd_min", "eth_balance_usd_max").orderBy(
        ranking.ascending("eth_balance_usd_min"), ranking.ascending("eth_balance_usd_max"))


def cohort_nft_overlap(src, collection, family=(), drop_unlabelled=False):
    """Other collections owned by the collection's holders.

    Flows are summed per (address, contract) before the join; each pair is then one row, so
    the holders of a contract are counted without a distinct.
    """
    own = (collection, *family)
    rows = src.table("erc721_transfers").filter(
        F.col("contract_address").isNotNull() & ~F.col("contract_address").isin(*own))
    people = materialise(collection_holders(src, collection))
    legs = _item_flows(rows, keys=("contract_address",), label=True)
    moved = (flows.narrow_to(legs, "address", people, src.broadcast_rows)
             .groupBy("address", "contract_address")
             .agg(F.sum("transfer_amount").alias("items"),
                  F.count(F.when(F.col("transfer_type") == "buy", 1)).alias("received")))
    count = people.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_contract = (moved.filter(F.col("received") > 0).join(people, "address")
                    .groupBy("contract_address")
                    .agg(F.count(F.when(F.col("items") > 0, 1)).alias("address_cnt")))
    labels = src.table("tokens_nft").select("contract_address", "name").distinct()
    named = per_contract.join(labels, "contract_address", "inner" if drop_unlabelled else "left")
    return named.select(
        explorer_link("contract_address", ADDRESS_PAGE, "Click").alias("etherscan_link"), "name",
        "contract_address", "address_cnt", ratio("address_cnt", count).alias("address_share"),
    ).orderBy(ranking.descending("address_cnt"), "contract_address")


# --- holders -----------------------------------------------------------------------------

def _side_by_side(src, collections, exclude):
    """Net items per day and address, one column per collection of the family."""
    legs = _legs(src, collections.values(), keys=("contract_address",))
    if exclude:
        legs = flows.exclude_addresses(legs, addresses=exclude)
    return legs, [
        F.sum(F.when(F.col("contract_address") == ca, F.col("transfer_amount")).otherwise(0))
        .alias(f"{name}_cnt") for name, ca in collections.items()]


def combination_rules(collections):
    """Holders of the first of three collections by what they hold of the other two."""
    first, second, third = [F.col(f"{name}_cnt") for name in collections]
    a, b, c = collections
    return {
        a: (first > 0) & (second == 0) & (third == 0),
        f"{a}_{c}": (first > 0) & (second == 0) & (third > 0),
        f"{a}_{b}": (first > 0) & (second > 0) & (third == 0),
        f"{a}_{b}_{c}": (first > 0) & (second > 0) & (third > 0),
    }


def derivative_items(src, collections, exclude=(ZERO_ADDRESS,)):
    """Holders per day by combination of three collections.

    ``collections`` maps a short name to a contract; the first is the main collection. An
    active day changes the combination of one address, so the daily counts are running sums
    of those changes.
    """
    # Excluded addresses keep their days, which belong to the calendar, and hold nothing.
    legs, sums = _side_by_side(src, collections, ())
    names = [f"{name}_cnt" for name in collections]
    owner = F.coalesce(not_sink("address", exclude), F.lit(False))
    net = legs.groupBy("date", "address").agg(*sums).select(
        "date", "address", *[F.when(owner, F.col(n)).otherwise(0).alias(n) for n in names])
    active = balances.active_balances(net, measures=names, out={n: n for n in names})
    rules = combination_rules(collections)
    states = active.select("date", F.inline(F.array(
        F.struct(F.lit(1).alias("sign"), *[F.col(n) for n in names]),
        F.struct(F.lit(-1).alias("sign"), *[F.col(f"prev_{n}").alias(n) for n in names]))))
    moves = states.select("date", *[
        F.when(rule, F.col("sign")).otherwise(0).alias(k) for k, rule in rules.items()])
    return balances.daily_totals(moves, src.today, list(rules)).orderBy("date")


def holding_distribution(src, collection, include_nonpositive=False):
    """How many addresses own how many items."""
    totals = balances.current_totals(
        flows.exclude_addresses(_legs(src, collection)), out="nfts_cnt")
    return stats.holdings_distribution(
        totals, include_nonpositive=include_nonpositive).orderBy("nfts_cnt")


def each_holder(src, collections):
    """Item counts of every holder in each collection of the family."""
    legs, sums = _side_by_side(src, collections, SINK_ADDRESSES)
    names = [f"{name}_cnt" for name in collections]
    held = F.lit(False)
    for n in names:
        held = held | (F.col(n) > 0)
    per = legs.groupBy("address").agg(*sums).filter(held)
    return per.select(explorer_link("address", ADDRESS_PAGE).alias("address"), *names).orderBy(
        *[ranking.descending(n) for n in names], "address")


def hhi_daily(src, collection, since=None, lines=HHI_LINES):
    """Concentration of ownership per day with constant reference lines.

    Sums and squared sums of balances move only on active days; both are kept as exact
    integers and divided last.
    """
    def squared(name):
        wide = F.col(name).cast("decimal(19,0)")
        return (wide * wide).cast("decimal(38,0)")

    moves = _active(src, collection).select(
        "date", (F.col("balance") - F.col("prev_balance")).cast("decimal(38,0)").alias("_s"),
        (squared("balance") - squared("prev_balance")).cast("decimal(38,0)").alias("_q"))
    totals = balances.daily_totals(moves, src.today, ["_s", "_q"])
    if since is not None:
        totals = totals.filter(F.col("date") > F.lit(since).cast("date"))
    return totals.select(
        "date", ranking.hhi_ratio(F.col("_s"), F.col("_q")).alias("hhi"),
        *[F.lit(float(x)).alias(f"{x:.2f} Line") for x in lines]).orderBy("date")


def holders_in_out(src, collection):
    """Addresses that became or ceased to be holders per day."""
    return activity.transitions_from_active(_active(src, collection), src.today).orderBy("date")


def holders_main(src, collection):
    """Holders per day and their change over 1, 7 and 30 days."""
    moves = _active(src, collection).select("date", (
        (F.col("balance") > 0).cast("long") - (F.col("prev_balance") > 0).cast("long"))
        .alias("holders_cnt"))
    counts = balances.daily_totals(moves, src.today, ["holders_cnt"])
    return activity.lag_delta(
        counts, "holders_cnt", {"holders_dod": 1, "holders_wow": 7, "holders_mom": 30},
        sign_of="holders_dod", sign_out="holders_dod_group").orderBy("date")


# --- market ------------------------------------------------------------------------------

def _sales(src, collection):
    """Priced sales between owners; rows without both parties are dropped."""
    return src.table("nft_trades").filter(
        (F.col("nft_contract_address") == collection) & F.col("tx_hash").isNotNull()
        & F.col("amount_usd").isNotNull() & not_sink("tx_from") & not_sink("tx_to"))


def nft_price_volume(src, collection, exact_windows=False):
    """Prices and volume per day with trailing means of the lowest price.

    Days without a sale repeat the latest prices. The median is exact at any number of sales:
    the least price that half of the day's sales do not exceed.
    """
    sales = materialise(_sales(src, collection).select(F.to_date("block_date").alias("date"), "amount_usd", "tx_hash"))
    # one row per calendar day
    medians = F.broadcast(ranking.middle(sales, "date", "amount_usd", "median_price_usd"))
    daily = sales.groupBy("date").agg(
        F.min("amount_usd").alias("min_price_usd"), F.max("amount_usd").alias("max_price_usd"),
        F.count_distinct("tx_hash").alias("tx_count"), F.sum("amount_usd").alias("tx_volume_usd")).join(medians, "date")
    dense = spines.fill_days(
        daily, src.today, carry=["min_price_usd", "median_price_usd", "max_price_usd"],
        on_day=["tx_count", "tx_volume_usd"], absent={"tx_count": 0})
    windows = {f"min_price_usd_ma_{n}d": n for n in (7, 28, 90)}
    return (prices.moving_average(dense, "min_price_usd", windows, exact=exact_windows)
            .withColumnRenamed("date", "block_date").orderBy(F.col("block_date").desc()))


def nft_token_stats(src, collection):
    """Price history in figures for every item ever sold."""
    newest = F.struct("block_time", "tx_hash", "amount_usd")
    per = _sales(src, collection).groupBy("token_id").agg(
        F.to_date(F.max("block_time")).alias("recent_trade_date"),
        F.max_by("amount_usd", newest).alias("_recent"), F.min("amount_usd").alias("_min"),
        F.max("amount_usd").alias("_max"), F.count_distinct("tx_hash").alias("tx_count"),
        F.sum("amount_usd").alias("_volume"))
    figures = per.select(
        explorer_link("token_id", f"{NFT_PAGE}{collection}/", "Click").alias("etherscan_link"),
        "token_id", "recent_trade_date", F.round("_recent", 2).alias("recent_price_usd"),
        F.round("_min", 2).alias("min_price_usd"), F.round("_max", 2).alias("max_price_usd"),
        F.round(ratio("_max", "_min") - 1, 4).alias("price_rate_high_low"),
        F.round(ratio("_recent", "_min") - 1, 4).alias("price_rate_recent_low"),
        "tx_count", F.round("_volume", 2).alias("tx_volume_usd"))
    # ids are whole numbers in text
    return stats.confidence_band(figures, "min_price_usd").orderBy(F.length("token_id"), "token_id")
