"""Every operator and report run over the driver's tables."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import uuid
from functools import partial, reduce

from pyspark.sql import functions as F

from chaintally import Sources
from chaintally.constants import ADDRESS_PAGE
from chaintally.functions.columns import explorer_link, scaled
from chaintally.operators import activity, balances, flows, prices, ranking, spines, stats
from chaintally.plans import account, collection, token
from chaintally.session import shared_folder
from chaintally.sources.activity_store import ActivityStore
from chaintally.sources.balance_store import BalanceStore
from chaintally.sources.catalog import write_layer
from chaintally.sources.layers import LayerStore
from chaintally.sources.zones import ZoneIndex
from verification.ledgers import (
    ACCOUNT, COLLECTION, EVENT_DAY, FAMILY, OTHER_TOKEN, TOKEN, Ledgers)


def rounded(df, **places):
    """Fix the last digits of averages and shares, which depend on the order of addition."""
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(f"`{c}`")
                       for c in df.columns])


def cents(df, *columns):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in columns else F.col(c) for c in df.columns])


# --- inputs of the operator queries ------------------------------------------------------

def _events(spark, root, funded=False):
    return Ledgers(spark, root).event_sources(funded)


def _orders(spark, root, funded=False):
    return Ledgers(spark, root).order_sources(funded)


def _all_transfers(src):
    return src.table("erc20_transfers").select(
        F.to_date("evt_block_time").alias("date"), "evt_block_time", "evt_tx_hash", "contract_address",
        F.col("from").alias("from_address"), F.col("to").alias("to_address"), "value")


def _click(src):
    return _all_transfers(src).filter(F.col("contract_address") == TOKEN)


def _click_net(src):
    return flows.net_flows(flows.signed_flows(_click(src), "value", pre_aggregate=False))


def _click_grid(src, gaps="carry"):
    net = _click_net(src)
    return balances.running_balance(net, spines.first_day(net), src.today, gaps=gaps)


def _click_totals(src):
    legs = flows.signed_flows(_click(src), "value", pre_aggregate=False)
    return balances.current_totals(legs)


def t01(spark, root):
    src = _events(spark, root)
    out = flows.scale_amount(_all_transfers(src), flows.token_info(src.table("tokens_erc20")))
    return out.select("evt_tx_hash", "contract_address", "token_symbol", "value_token")


def t02(spark, root):
    parts = Ledgers(spark, root).read("part")
    return flows.token_info(parts.select(
        F.col("p_brand").alias("contract_address"), F.col("p_type").alias("symbol"),
        F.col("p_size").alias("decimals")))


def t03(spark, root):
    rows = flows.account_transfers(_events(spark, root).table("erc20_transfers"), ACCOUNT,
                                   tx_col="evt_tx_hash")
    return rows.select("evt_tx_hash", "ca_address", "transfer_type", "counter_address")


def t04(spark, root, pairing="zip"):
    batch = _events(spark, root).table("erc1155_batch").select("evt_tx_hash", "ids", "values")
    return cents(flows.explode_batch(batch, pairing=pairing), "id", "value")


def t05(spark, root):
    calls = flows.value_calls(_events(spark, root).table("traces"))
    return calls.select("tx_hash", "call_type", F.col("value").cast("double").alias("value"))


def t06(spark, root):
    return flows.gas_cost(_events(spark, root).table("gas_fees")).select("tx_hash", "gas_eth")


def t07(spark, root):
    legs = flows.signed_flows(_all_transfers(_events(spark, root)), "value", ("contract_address",),
                              label=True)
    return cents(legs, "transfer_amount")


def t08(spark, root):
    legs = flows.signed_flows(_all_transfers(_events(spark, root)), "value", ("contract_address",),
                              pre_aggregate=False)
    return cents(flows.net_flows(legs, ("date", "contract_address", "address")), "net_amount")


def t09(spark, root):
    rows = flows.account_transfers(_events(spark, root).table("erc20_transfers"), ACCOUNT)
    daily = flows.in_out_by_date(rows.withColumn("date", F.to_date("evt_block_time")), ["value"],
                                 ("contract_address",))
    return cents(daily, "value_in", "value_out", "value_net")


def t10(spark, root):
    src = _events(spark, root)
    return spines.date_spine(_click(src), "date", src.today)


def t11(spark, root):
    return spines.address_spine(_click(_events(spark, root)))


def t12(spark, root):
    src = _events(spark, root)
    rows = _click(src)
    return spines.dense_frame(spines.address_spine(rows), spines.first_day(rows), src.today)


def t13(spark, root, gaps="carry"):
    return cents(_click_grid(_events(spark, root), gaps), "balance")


def t14(spark, root):
    return prices.daily_close(_events(spark, root).table("prices_usd"))


def t15(spark, root):
    return prices.latest_price(_events(spark, root).table("prices_usd"))


def t16(spark, root):
    src = _events(spark, root)
    legs = flows.signed_flows(_all_transfers(src), "value", ("contract_address",), pre_aggregate=False)
    net = flows.net_flows(legs, ("date", "contract_address", "address"))
    amounts = net.select("date", "contract_address", "address", scaled("net_amount", 2).alias("amount"))
    return prices.attach_usd(amounts, prices.daily_close(src.table("prices_usd")),
                             ("date", "contract_address"), "amount", "amount_usd")


def t16_as_of(spark, root):
    src = _events(spark, root)
    ticks = src.table("prices_usd").filter("minute(minute) % 7 = 0")
    rows = _all_transfers(src).select("evt_tx_hash", "contract_address", "evt_block_time", scaled("value", 2).alias("amount"))
    priced = prices.attach_as_of(rows, ticks)
    return priced.select("*", (F.col("amount") * F.col("last_price")).alias("amount_usd"))


def t17(spark, root):
    src = _events(spark, root)
    return activity.rolling_distinct(_all_transfers(src), {"": "to_address"},
                                     {"dau": 1, "wau": 7, "mau": 30}, src.today)


def t18(spark, root):
    src = _events(spark, root)
    return activity.cumulative_distinct(_all_transfers(src), "to_address", src.today)


def t19(spark, root):
    rows = _all_transfers(_events(spark, root)).withColumnRenamed("from_address", "address")
    return flows.exclude_addresses(rows).select("evt_tx_hash", "address")


def t20(spark, root):
    rows = _all_transfers(_events(spark, root)).withColumnRenamed("to_address", "address")
    newest = ranking.latest_per_key(
        rows.select("date", "evt_block_time", "address", "value"), ["address"], "evt_block_time")
    return cents(newest.drop("evt_block_time"), "value")


def t21(spark, root):
    per = (_all_transfers(_events(spark, root)).groupBy("date", F.col("to_address").alias("address"))
           .agg(F.sum("value").alias("v")))
    return cents(ranking.topn_with_others(per, "v", out="volume"), "volume")


def t22(spark, root):
    rows = _all_transfers(_events(spark, root)).select("evt_tx_hash", "value")
    return cents(ranking.top_n(
        rows, [ranking.descending("value"), ranking.ascending("evt_tx_hash")]), "value")


def t23(spark, root):
    owned = flows.exclude_addresses(_click_totals(_events(spark, root, True)).filter("balance > 0"))
    return rounded(cents(ranking.share_of_total(owned, "balance"), "balance"), share=9)


def t23_day(spark, root):
    grid = flows.exclude_addresses(_click_grid(_events(spark, root, True)))
    return rounded(cents(ranking.share_of_total(grid, "balance", "date"), "balance"), share=9)


def t24(spark, root):
    return rounded(ranking.hhi(flows.exclude_addresses(_click_grid(_events(spark, root, True)))), hhi=9)


def t25(spark, root):
    owned = _click_totals(_events(spark, root))
    return cents(ranking.cumulative_position(
        owned, [ranking.ascending("balance"), ranking.ascending("address")]), "balance")


def t26(spark, root):
    owned = _click_totals(_events(spark, root)).withColumn("v", scaled("balance", 2))
    return ranking.percentile_class(owned, "balance", "v")


def t27(spark, root):
    close = prices.daily_close(_events(spark, root).table("prices_usd")).filter(
        F.col("contract_address") == TOKEN).select("date", "close_price")
    return rounded(prices.moving_average(close, "close_price", {"ma_7": 7, "ma_14": 14}),
                   ma_7=9, ma_14=9)


def t28(spark, root):
    src = _orders(spark, root)
    sold = src.table("nft_trades").filter(F.col("nft_contract_address") == COLLECTION)
    daily = sold.groupBy(F.col("block_date").alias("date")).agg(F.max("amount_usd").alias("price"))
    gaps = spines.fill_days(daily, src.today, on_day=["price"])
    return prices.forward_fill(gaps, ["price"])


def t29(spark, root):
    grid = collection.daily_balance(_orders(spark, root), COLLECTION)
    counts = grid.groupBy("date").agg(F.count(F.when(F.col("balance") > 0, 1)).alias("holders_cnt"))
    return activity.lag_delta(
        counts, "holders_cnt", {"holders_dod": 1, "holders_wow": 7, "holders_mom": 30},
        sign_of="holders_dod", sign_out="holders_dod_group")


def t30(spark, root):
    return activity.holder_transitions(collection.daily_balance(_orders(spark, root), COLLECTION))


def t31(spark, root):
    return activity.new_holders(collection.daily_balance(_orders(spark, root), COLLECTION), "month")


def t32(spark, root):
    src = _events(spark, root)
    legs = flows.signed_flows(_click(src), "value", pre_aggregate=False, label=True)
    close = prices.daily_close(src.table("prices_usd")).filter(F.col("contract_address") == TOKEN)
    return rounded(stats.avg_purchase_price(legs, close, F.lit(2)), avg_purchase_price_usd=6)


def t33(spark, root):
    grid = flows.exclude_addresses(_click_grid(_events(spark, root)))
    b = F.col("balance")
    return stats.segment_counts(grid, {"large": b > 10000, "small": (b > 0) & (b <= 10000)})


def t34(spark, root):
    return collection.holding_distribution(_orders(spark, root, True), COLLECTION)


def t35(spark, root):
    parts = Ledgers(spark, root).read("part").select("p_partkey", "p_retailprice")
    return rounded(stats.confidence_band(parts, "p_retailprice"), confidence_lower=4, confidence_upper=4)


def t36(spark, root):
    return flows.orient_trades(_orders(spark, root).table("dex_trades"), COLLECTION).drop("datetime")


VOLUMES = dict.fromkeys([f"tx_volume_{u}_{s}" for u in ("token", "usd") for s in ("buy", "sell")], 2)


def t37(spark, root):
    rows = token.trades(_orders(spark, root), COLLECTION)
    return rounded(stats.trade_measures(rows, ["project", "counter_token_ca"]), **VOLUMES)


def t38(spark, root):
    src = _events(spark, root)
    who = token.holders(src, TOKEN).select("address")
    owned = stats.current_balance(who, token.native_totals(src), "wei_in", ["wei_out", "wei_gas"])
    return owned.select("address", scaled("balance", 18).alias("balance"))


def t39(spark, root):
    src = _events(spark, root)
    kept = flows.restrict_to(src.table("traces"), "from", token.holders(src, TOKEN))
    return kept.select("tx_hash", F.col("value").cast("double").alias("value"))


def t40(spark, root):
    split = stats.supply_mint_burn(_click_grid(_events(spark, root)))
    return split.select("date", *[scaled(m, 2).alias(m) for m in split.columns[1:]])


def t41(spark, root):
    who = spines.address_spine(_click(_events(spark, root)))
    return who.select("address", explorer_link("address", ADDRESS_PAGE).alias("link"),
                      explorer_link("address", ADDRESS_PAGE, "Click").alias("short_link"))


def t42(spark, root):
    return account.contract_profile(_events(spark, root), FAMILY["third"])


# --- reports -----------------------------------------------------------------------------

def event(report, *args, funded=False, places=None, as_of=None, **kw):
    def run(spark, root):
        src = _events(spark, root, funded)
        src.as_of = as_of or src.as_of
        df = report(src, *(args or (TOKEN,)), **kw)
        return rounded(df, **places) if places else df

    return run


def order(report, *args, funded=False, places=None, **kw):
    def run(spark, root):
        df = report(_orders(spark, root, funded), *(args or (COLLECTION,)), **kw)
        return rounded(df, **places) if places else df

    return run


# --- sources and layers ------------------------------------------------------------------

#: A day before the end of the events, for reports that look back.
EARLIER = dt.date(2024, 1, 15)


def a01_wide_amounts(spark, root):
    """R7 over amounts of 60 more digits, in text."""
    src = _events(spark, root)
    wide = src.table("erc20_transfers").withColumn("value", F.concat(F.col("value").cast("string"), F.lit("0" * 60)))
    info = src.table("tokens_erc20").withColumn("decimals", F.lit(62))
    src = Sources({**src.tables, "erc20_transfers": wide, "tokens_erc20": info}, src.as_of)
    return rounded(token.overlap_erc20(src, TOKEN).select("address", "contract_address", "balance_token"), balance_token=6)


def _wide(src):
    """The sources with amounts of 33 to 45 digits in text: every amount n becomes n (10^36 + 10^18), in tokens of 36 more digits.

    The two copies of n lie in two limbs, and sums of the lower ones carry.
    """
    rows = src.table("erc20_transfers")
    n = F.col("value").cast("string")
    rows = rows.withColumn("value", F.when(F.col("value") == 0, "0").otherwise(F.concat(n, F.lpad(n, 18, "0"), F.lit("0" * 18))))
    info = src.table("tokens_erc20").withColumn("decimals", F.col("decimals") + 36)
    return Sources({**src.tables, "erc20_transfers": rows, "tokens_erc20": info}, src.as_of)


def wide_event(report, *columns, funded=False, **kw):
    """A report over wide amounts; the last digits of its doubles are rounded away."""
    def run(spark, root):
        df = report(_wide(_events(spark, root, funded)), TOKEN, **kw)
        return rounded(df, **dict.fromkeys(columns, 6))

    return run


def _wide_cohort(spark, root):
    bands = ("token_balance_usd_min", "token_balance_usd_max")
    df = collection.cohort_token_class(_wide(_mixed(spark, root)), COLLECTION, TOKEN, 38)
    return rounded(df, **dict.fromkeys(bands, 6))


@functools.cache
def _stored_tables(spark, root):
    """The event tables as users store them: amounts as text, addresses in mixed case; written once per process."""
    path, src = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex[:12]}", _wide(_events(spark, root, True))
    for name in ("erc20_transfers", "erc721_transfers", "tokens_erc20", "tokens_nft", "prices_usd"):
        df = src.table(name)
        for c in ("from", "to"):
            if c in df.columns:
                df = df.withColumn(c, F.concat(F.lit("0x"), F.upper(F.substring(c, 3, 40))))
        df.write.parquet(f"{path}/{name}")
    return path


#: Sources that are read back from Parquet as they are, and the set of tables that shapes them.
PLAIN = {"erc1155_single": "events", "erc1155_batch": "events", "traces": "events", "gas_fees": "events", "prices_usd": "events",
         "tokens_erc20": "events", "tokens_nft": "orders", "dex_trades": "orders", "nft_trades": "orders", "contracts": "events"}


def source_table(name):
    """A source table as reports get it: written as Parquet, opened, checked and cut by ``Sources.from_parquet``."""
    def run(spark, root):
        path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex[:12]}"
        src = _events(spark, root) if PLAIN[name] == "events" else _orders(spark, root)
        src.tables[name]().write.parquet(f"{path}/{name}")
        df = Sources.from_parquet(spark, path, src.as_of).table(name).drop("blockchain")
        if name == "erc1155_batch":
            df = flows.explode_batch(df)
        if name == "traces":
            df = df.withColumns({"value": F.col("value").cast("double"), "input": F.col("input").cast("string")})
        return cents(df, "value") if name.startswith("erc1155") else df

    return run


def from_parquet(report, *args, places=()):
    """A report over tables that ``Sources.from_parquet`` opens, checks and normalises."""
    def run(spark, root):
        src = Sources.from_parquet(spark, _stored_tables(spark, root), EVENT_DAY, normalised=False)
        return rounded(report(src, *(args or (TOKEN,))), **dict.fromkeys(places, 6))

    return run


def a02_wide_ids(spark, root):
    """R34 over item ids of 78 digits."""
    src = _orders(spark, root)
    named = src.table("erc721_transfers").withColumn("tokenId", F.lpad("tokenId", 78, "9"))
    return account.account_transfers_erc721(Sources({"erc721_transfers": named}, src.as_of), ACCOUNT)


def _from_layer(report, funded):
    def run(spark, root):
        src = _events(spark, root, funded)
        path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex[:12]}"
        stored = write_layer(token.ledger(src, TOKEN), path, cluster_by="from_address")
        names = ("tokens_erc20", "prices_usd")
        return report(Sources({n: src.tables[n] for n in names}, src.as_of, layers={("ledger", TOKEN): stored}), TOKEN)

    return run


def _store(spark):
    return BalanceStore(spark, f"{shared_folder(spark)}/balances-{uuid.uuid4().hex[:12]}")


def _appended(spark, root, shape=lambda src: src):
    """A store of balances up to EARLIER, then extended from sources that lack all days before."""
    src = shape(_events(spark, root))
    store = _store(spark)
    token.store_balances(Sources(src.tables, EARLIER), TOKEN, store)
    rows = src.table("erc20_transfers").filter(F.col("evt_block_time") >= F.lit(EARLIER + dt.timedelta(days=1)))
    src = Sources({**src.tables, "erc20_transfers": rows}, src.as_of)
    token.store_balances(src, TOKEN, store)
    return src, store


def a14_balance_appended(spark, root):
    src, store = _appended(spark, root)
    return token.balance_from_store(src, TOKEN, store)


def a14_balance_appended_wide(spark, root):
    src, store = _appended(spark, root, _wide)
    return rounded(token.balance_from_store(src, TOKEN, store), balance_token=6)


def a14_balance_by_days(spark, root):
    """A store that grows day by day, until its snapshots are folded."""
    src, store = _events(spark, root), _store(spark)
    for n in (30, 29, 28, 27, 26, 25, 24, 23, 22, 21, 20, 19, 18, 17, 16, 14, 7, 0):
        token.store_balances(Sources(src.tables, src.as_of - dt.timedelta(days=n)), TOKEN, store)
    return token.balance_from_store(src, TOKEN, store)


def _days_store(spark, root, extend, name, table, at):
    """A store of active keys up to EARLIER, then extended from sources that lack all days before."""
    src = _events(spark, root)
    store = ActivityStore(spark, f"{shared_folder(spark)}/activity-{uuid.uuid4().hex[:12]}")
    extend(Sources(src.tables, EARLIER), name, store)
    rows = src.table(table).filter(F.col(at) >= F.lit(EARLIER + dt.timedelta(days=1)))
    src = Sources({**src.tables, table: rows}, src.as_of)
    extend(src, name, store)
    return src, store


def r09_from_days(spark, root):
    return token.active_addresses_from_store(
        *_days_store(spark, root, token.store_activity, TOKEN, "erc20_transfers", "evt_block_time"))


def r52_from_days(spark, root):
    return account.contract_active_users_from_store(
        *_days_store(spark, root, account.store_callers, ACCOUNT, "traces", "block_time"))


def r03_on_day(spark, root):
    src, store = _appended(spark, root)
    return token.balance_on_day(src, TOKEN, dt.date(2024, 1, 10), store)


def _from_store(report, funded=True):
    """Reports that share one stored view of net flows, for all runs of the process over the same tables."""
    def run(spark, root):
        src = _events(spark, root, funded)
        name = hashlib.sha256(root.encode()).hexdigest()[:12]
        src.layers = LayerStore(spark, f"{shared_folder(spark)}/layers-{name}-{'funded' if funded else 'raw'}")
        return report(src, TOKEN)

    return run


def _r32(spark, root):
    return cents(account.account_transfers_erc1155(_events(spark, root), ACCOUNT), "id", "value")


def _r34(spark, root):
    return cents(account.account_transfers_erc721(_orders(spark, root), ACCOUNT), "tokenId")


def _r35(spark, root):
    rows = account.account_transfers_eth(_events(spark, root), ACCOUNT)
    return rows.withColumn("data", F.col("data").cast("string"))


def _r46(spark, root):
    src = _events(spark, root)
    first_nation = Ledgers(spark, root).read("nation").filter("n_nationkey = 0").select("n_name").scalar()
    found = [account.contract_profile(src, a)
             for a in (TOKEN, COLLECTION, "1-URGENT", first_nation)]
    return reduce(lambda a, b: a.unionByName(b), found)


def _r46_by_zones(spark, root):
    """R46 over stored ledgers whose zone indexes are probed."""
    src, path = _events(spark, root), f"{shared_folder(spark)}/zones-{uuid.uuid4().hex[:12]}"
    for name in ("erc20_transfers", "erc721_transfers", "erc1155_single", "erc1155_batch"):
        write_layer(src.table(name), f"{path}/{name}", (), cluster_by="contract_address")
        src.zones[name] = ZoneIndex(spark, f"{path}/{name}")
    first_nation = Ledgers(spark, root).read("nation").filter("n_nationkey = 0").select("n_name").scalar()
    nation = spark.range(1).select(first_nation).first()[0]
    found = [account.contract_profile(src, a) for a in (TOKEN, COLLECTION, "1-URGENT", nation)]
    return reduce(lambda a, b: a.unionByName(b), found)


def _r51(spark, root):
    figures = collection.nft_token_stats(_orders(spark, root), COLLECTION)
    return cents(rounded(figures, confidence_lower=4, confidence_upper=4), "token_id")


MA = dict.fromkeys(("ma_5d", "ma_10d", "ma_20d", "ma_60d"), 9)
NFT = {"tx_volume_usd": 2, **dict.fromkeys([f"min_price_usd_ma_{n}d" for n in (7, 28, 90)], 7)}


def all_queries():
    found = {
        "a01_wide_amounts": a01_wide_amounts, "a02_wide_ids": a02_wide_ids,
        "a01_holders_from_parquet": from_parquet(token.holders, places=("balance_token",)),
        "a01_balance_from_parquet": from_parquet(token.balance, places=("balance_token",)),
        "a01_overlap_from_parquet": from_parquet(token.overlap_erc20, places=("balance_token", "balance_usd")),
        "r11_current_holders_sparse": event(token.current_holders, gaps="sparse"),
        "r12_new_holders_daily_sparse": event(token.new_holders_daily, gaps="sparse"),
        "r13_new_holders_weekly_sparse": order(token.new_holders_weekly, gaps="sparse"),
        "r14_new_holders_monthly_sparse": order(token.new_holders_monthly, gaps="sparse"),
        "r12_new_holders_daily_first": event(token.new_holders_daily, first_time_only=True),
        "r13_new_holders_weekly_first": order(token.new_holders_weekly, first_time_only=True),
        "r12_new_holders_daily_sparse_first": event(token.new_holders_daily, gaps="sparse", first_time_only=True),
        "r20_wealth_gap_balance_sparse": event(token.wealth_gap_balance, gaps="sparse"),
        "r28_marketcap_sparse": event(token.marketcap, gaps="sparse"),
        "r31_tokenomics_sparse": event(token.tokenomics, gaps="sparse"),
        "r29_price_with_ma_exact": event(token.price_with_ma, exact=True, places=MA),
        "r41_cohort_nft_overlap_labelled": event(
            collection.cohort_nft_overlap, COLLECTION, (FAMILY["second"], FAMILY["third"]), funded=True, drop_unlabelled=True),
        "r50_nft_price_volume_exact": order(collection.nft_price_volume, exact_windows=True, places=NFT),
        "a13_holders_from_layer": _from_layer(token.holders, True),
        "a14_volume_from_layer": _from_layer(token.volume, False),
        "r08_overlap_eth_earlier": event(token.overlap_eth, as_of=EARLIER),
        "r15_other_coins_eth_earlier": event(token.other_coins_eth, as_of=EARLIER),
        "r42_cohort_eth_class_earlier": event(
            collection.cohort_eth_class, COLLECTION, TOKEN, "Click", funded=True, as_of=EARLIER),
        "t16_as_of": t16_as_of,
        "t39_restrict_to_beyond": t39_beyond,
        "r07_overlap_erc20_beyond": beyond(token.overlap_erc20, _events, TOKEN),
        "r08_overlap_eth_beyond": beyond(token.overlap_eth, _events, TOKEN),
        "r15_other_coins_eth_beyond": beyond(token.other_coins_eth, _events, TOKEN),
        "r16_other_coins_erc20_beyond": beyond(token.other_coins_erc20, _events, TOKEN, OTHER_TOKEN),
        "r40_cohort_token_class_click_beyond": beyond(collection.cohort_token_class, _mixed, COLLECTION, TOKEN, 2),
        "r41_cohort_nft_overlap_beyond": beyond(
            collection.cohort_nft_overlap, partial(_events, funded=True), COLLECTION, (FAMILY["second"], FAMILY["third"])),
        "r42_cohort_eth_class_beyond": beyond(
            collection.cohort_eth_class, partial(_events, funded=True), COLLECTION, TOKEN, "Click"),
        "a13_holders_from_views": _from_store(token.holders),
        "a13_supply_from_views": _from_store(token.supply_mint_burn),
        "a13_current_holders_from_views": _from_store(token.current_holders, False),
        "a13_top_holders_from_views": _from_store(
            lambda src, t: rounded(token.top_holders_list(src, t), share=9)),
        "a13_wealth_gap_balance_from_views": _from_store(token.wealth_gap_balance),
        "a13_marketcap_from_views": _from_store(token.marketcap),
        "a13_price_daily_from_views": _from_store(token.price_daily, False),
        "a14_balance_appended": a14_balance_appended,
        "a14_balance_appended_wide": a14_balance_appended_wide,
        "a14_balance_by_days": a14_balance_by_days,
        "r03_on_day": r03_on_day,
        "r09_active_addresses_from_days": r09_from_days,
        "r52_contract_active_users_from_days": r52_from_days,
        "t01_scale_amount": t01, "t02_token_info": t02, "t03_account_transfers": t03,
        "t04_explode_batch": t04, "t04_explode_batch_cross": partial(t04, pairing="cross"),
        "t05_value_calls": t05, "t06_gas_cost": t06, "t07_signed_flows": t07, "t08_net_flows": t08,
        "t09_in_out_by_date": t09, "t10_date_spine": t10, "t11_address_spine": t11,
        "t12_dense_frame": t12, "t13_running_balance": t13,
        "t13_running_balance_sparse": partial(t13, gaps="sparse"), "t14_daily_close": t14,
        "t15_latest_price": t15, "t16_attach_usd": t16, "t17_rolling_distinct": t17,
        "t18_cumulative_distinct": t18, "t19_exclude_addresses": t19, "t20_latest_per_key": t20,
        "t21_topn_with_others": t21, "t22_top_n": t22, "t23_share_of_total": t23,
        "t23_share_of_day": t23_day, "t24_hhi": t24, "t25_cumulative_position": t25,
        "t26_percentile_class": t26, "t27_moving_average": t27, "t28_forward_fill": t28,
        "t29_lag_delta": t29, "t30_holder_transitions": t30, "t31_new_holders": t31,
        "t32_avg_purchase_price": t32, "t33_segment_counts": t33, "t34_holdings_distribution": t34,
        "t35_confidence_band": t35, "t36_orient_trades": t36, "t37_trade_measures": t37,
        "t38_current_balance": t38, "t39_restrict_to": t39, "t40_supply_mint_burn": t40,
        "t41_explorer_link": t41, "t42_contract_profile": t42,
        "r01_transfers": event(token.transfers),
        "r02_trades": order(token.trades),
        "r03_balance": event(token.balance),
        "r03_balance_orders": order(token.balance),
        "r03_balance_sparse": event(token.balance, gaps="sparse"),
        "r04_price_daily": event(token.price_daily),
        "r03_balance_wide": wide_event(token.balance, "balance_token"),
        "r05_holders": event(token.holders, funded=True),
        "r06_supply_mint_burn_wide": wide_event(token.supply_mint_burn, "total_supply", "total_mint", "total_burn", funded=True),
        "r06_supply_mint_burn_sparse_wide": wide_event(
            token.supply_mint_burn, "total_supply", "total_mint", "total_burn", gaps="sparse"),
        "r10_avg_purchase_price_wide": wide_event(token.avg_purchase_price, "balance_token", "avg_purchase_price_usd"),
        "r11_current_holders_wide": wide_event(token.current_holders),
        "r12_new_holders_daily_wide": wide_event(token.new_holders_daily),
        "r16_other_coins_erc20_wide": wide_event(
            partial(token.other_coins_erc20, other=OTHER_TOKEN), "balance_token", "balance_usd"),
        "r18_wealth_gap_txs_wide": wide_event(token.wealth_gap_txs),
        "r20_wealth_gap_balance_wide": wide_event(token.wealth_gap_balance, "balance_token", funded=True),
        "r20_wealth_gap_balance_poor_wide": wide_event(token.wealth_gap_balance, "balance_token"),
        "r22_wealth_gap_volume_wide": wide_event(token.wealth_gap_volume, "tx_volume_token"),
        "r28_marketcap_wide": wide_event(token.marketcap, "marketcap", funded=True),
        "r30_volume_wide": wide_event(token.volume, "volume_token", "volume_usd"),
        "r40_cohort_token_class_wide": _wide_cohort,
        "r06_supply_mint_burn": event(token.supply_mint_burn, funded=True),
        "r06_supply_mint_burn_sparse": event(token.supply_mint_burn, gaps="sparse"),
        "r07_overlap_erc20": event(token.overlap_erc20),
        "r07_overlap_erc20_priced": event(token.overlap_erc20, drop_unpriced=True),
        "r08_overlap_eth": event(token.overlap_eth),
        "r09_active_addresses": event(token.active_addresses),
        "r10_avg_purchase_price": event(token.avg_purchase_price, places={"avg_purchase_price_usd": 6}),
        "r11_current_holders": event(token.current_holders),
        "r12_new_holders_daily": event(token.new_holders_daily),
        "r13_new_holders_weekly": order(token.new_holders_weekly),
        "r14_new_holders_monthly": order(token.new_holders_monthly),
        "r15_other_coins_eth": event(token.other_coins_eth),
        "r16_other_coins_erc20": event(token.other_coins_erc20, TOKEN, OTHER_TOKEN),
        "r17_top_holders_list": event(token.top_holders_list, funded=True, places={"share": 9}),
        "r18_wealth_gap_txs": event(token.wealth_gap_txs),
        "r19_wealth_gap_txs_today": event(token.wealth_gap_txs_today),
        "r20_wealth_gap_balance": event(token.wealth_gap_balance, funded=True),
        "r20_wealth_gap_balance_orders": order(token.wealth_gap_balance),
        "r21_wealth_gap_balance_today": event(token.wealth_gap_balance_today, funded=True),
        "r22_wealth_gap_volume": event(token.wealth_gap_volume),
        "r23_wealth_gap_volume_today": event(token.wealth_gap_volume_today),
        "r24_dex_dominance_by_platform": order(token.dex_dominance_by_platform, places=VOLUMES),
        "r25_dex_dominance_daily": order(token.dex_dominance_daily, places=VOLUMES),
        "r26_dex_pairs_by_symbol": order(token.dex_pairs_by_symbol, places=VOLUMES),
        "r27_dex_pairs_daily": order(token.dex_pairs_daily, places=VOLUMES),
        "r28_marketcap": event(token.marketcap, funded=True),
        "r29_price_with_ma": event(token.price_with_ma, places=MA),
        "r30_volume": event(token.volume),
        "r31_tokenomics": event(token.tokenomics),
        "r32_account_transfers_erc1155": _r32,
        "r33_account_transfers_erc20": event(account.account_transfers_erc20, ACCOUNT),
        "r34_account_transfers_erc721": _r34,
        "r35_account_transfers_eth": _r35,
        "r36_account_balance_erc20": event(account.account_balance_erc20, ACCOUNT),
        "r37_account_balance_erc721": order(account.account_balance_erc721, ACCOUNT),
        "r38_account_balance_eth": event(account.account_balance_eth, ACCOUNT),
        "r39_balance_erc20_view": event(account.balance_erc20_view, ACCOUNT),
        "r41_cohort_nft_overlap": event(
            collection.cohort_nft_overlap, COLLECTION, (FAMILY["second"], FAMILY["third"]), funded=True),
        "r42_cohort_eth_class": event(collection.cohort_eth_class, COLLECTION, TOKEN, "Click",
                                      funded=True),
        "r43_derivative_items": order(collection.derivative_items, FAMILY),
        "r44_holding_distribution": order(collection.holding_distribution, funded=True),
        "r45_each_holder": order(collection.each_holder, FAMILY),
        "r46_contract_profile": _r46,
        "r46_contract_profile_by_zones": _r46_by_zones,
        "r48_holders_in_out": order(collection.holders_in_out, funded=True),
        "r49_holders_main": order(collection.holders_main, funded=True),
        "r50_nft_price_volume": order(collection.nft_price_volume, places=NFT),
        "r51_nft_token_stats": _r51,
        "r52_contract_active_users": event(account.contract_active_users, ACCOUNT),
        "r53_contract_cumulative_users": event(account.contract_cumulative_users, ACCOUNT),
        "r54_balance_erc20_total": event(account.balance_erc20_total, ACCOUNT, places={"balance_usd": 6}),
        "r55_balance_eth_view": event(account.balance_eth_view, ACCOUNT),
    }
    for n, name in enumerate(PLAIN, 3):
        found[f"a{n:02d}_{name}"] = source_table(name)
    for name, ca in {**FAMILY, "fourth": "Brand#5"}.items():
        found[f"r47_hhi_daily_{name}"] = order(
            collection.hhi_daily, ca, since="1995-08-24", funded=True, places={"hhi": 9})
    for t in ("click", "purchase", "view", "signup", "error"):
        found[f"r40_cohort_token_class_{t}"] = _cohort(t)
    return found


def _cohort(contract):
    """The holders come from the funded collection, the token amounts from the raw ledger."""
    def run(spark, root):
        return collection.cohort_token_class(_mixed(spark, root), COLLECTION, contract, 2)

    return run


def beyond(report, sources, *args, **kw):
    """A report whose address sets are all above the limit for sending them to every task."""
    def run(spark, root):
        src = sources(spark, root)
        src.broadcast_rows = 0
        return report(src, *args, **kw)

    return run


def t39_beyond(spark, root):
    src = _events(spark, root)
    kept = flows.restrict_to(src.table("traces"), "from", token.holders(src, TOKEN), max_rows=0)
    return kept.select("tx_hash", F.col("value").cast("double").alias("value"))


def _mixed(spark, root):
    src = Ledgers(spark, root).event_sources()
    src.tables["erc721_transfers"] = Ledgers(spark, root).items_funded
    return src
