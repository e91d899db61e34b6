"""Reports about one fungible token: ledger, holders, price, supply and DEX markets.

Every report takes the sources and the token's contract address. Amounts stay integers in
raw units until the last step. ``gaps='carry'`` keeps a balance alive between transfers;
``gaps='sparse'`` shows it only on days with a transfer, as some published figures do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chaintally.constants import WEI_DECIMALS
from chaintally.functions import wide
from chaintally.functions.columns import not_sink, scaled, zero_if_null
from chaintally.operators import activity, balances, flows, prices, ranking, spines, stats
from chaintally.session import materialise
from chaintally.sources.layers import LayerStore


# --- shared pieces -----------------------------------------------------------------------

def _token_row(src, token):
    """Metadata of one token: a single row by construction of ``token_info``."""
    meta = src.table("tokens_erc20").filter(F.col("contract_address") == token)
    return flows.token_info(meta)


def _token_fields(src, token):
    """Symbol and decimals of the token as one scalar, NULL when it is not registered."""
    return _token_row(src, token).select(F.struct("token_symbol", "decimals").alias("info")).scalar()


def _named(df, src, token):
    """Attach the token's address, symbol and decimals without a join."""
    return (df.withColumn("token_ca", F.lit(token)).withColumn("_info", _token_fields(src, token))
            .select("*", "_info.token_symbol", "_info.decimals").drop("_info"))


def ledger(src, token):
    """Valid transfers of a registered token, in raw units: the layer to store for its reports.

    ``write_layer(ledger(src, token), path)`` stores it, and a ``Sources`` with it under
    ``layers["ledger", token]`` gives it to every report of that token. With a ``LayerStore`` the
    reports share its net flows instead, which are far smaller.
    """
    stored = src.layers.get(("ledger", token)) if isinstance(src.layers, dict) else None
    if stored is not None:
        return stored.filter(F.col("date") <= src.today).select(
            "datetime", "date", "tx_hash", "token_ca", "from_address", "to_address", "raw")
    rows = src.table("erc20_transfers").filter(
        (F.col("contract_address") == token) & F.col("evt_tx_hash").isNotNull()
        & F.col("from").isNotNull() & F.col("to").isNotNull())
    return rows.select(
        F.col("evt_block_time").alias("datetime"), F.to_date("evt_block_time").alias("date"),
        F.col("evt_tx_hash").alias("tx_hash"), F.col("contract_address").alias("token_ca"),
        F.col("from").alias("from_address"), F.col("to").alias("to_address"),
        F.col("value").alias("raw")).filter(_token_fields(src, token).isNotNull())


def _amounts(src, token):
    """The ledger with exact amounts to calculate with: decimals, or limbs where the ledger holds text."""
    return wide.amounts(ledger(src, token))


def _legs(src, token, label=False):
    return flows.signed_flows(_amounts(src, token), "raw", pre_aggregate=False, label=label)


_LEDGER = ("erc20_transfers", "tokens_erc20")


def net_flows(src, token):
    """Net flows per day and address: the view that balances, holders and supply are made of."""
    stored = _stored_net(src, token)
    return flows.net_flows(_legs(src, token)) if stored is None else stored


def _stored_net(src, token):
    found = src.view("net_flows", token, _LEDGER, lambda: flows.net_flows(_legs(src, token)))
    return None if found is None else found.filter(F.col("date") <= src.today)


def _moves(src, token):
    """Rows whose amounts sum to the flows: the stored net flows, or the legs of the ledger."""
    stored = _stored_net(src, token)
    return _legs(src, token) if stored is None else stored.withColumnRenamed("net_amount", "transfer_amount")


def _days(src, token):
    """Rows that span the days of the token's ledger."""
    stored = _stored_net(src, token)
    return ledger(src, token) if stored is None else stored


def _active(src, token):
    return balances.active_balances(net_flows(src, token))


def _net(src, token):
    """Net flows per day and address, written once for reports that use them repeatedly."""
    stored = _stored_net(src, token)
    return materialise(net_flows(src, token)) if stored is None else stored


def _raw_balance(src, token, gaps="carry"):
    net = _net(src, token)
    return balances.running_balance(net, spines.first_day(net), src.today, gaps=gaps)


def _close(src, token):
    """Daily close of one token: one row per calendar day."""
    def build():
        ticks = src.table("prices_usd").filter(F.col("contract_address") == token)
        return prices.daily_close(ticks, labels=("symbol",))

    stored = src.view("price_daily", token, ("prices_usd",), build)
    return build() if stored is None else stored.filter(F.col("date") <= src.today)


def _in_units(df, src, token, columns, keep):
    """Name the token and turn raw columns into token units."""
    named = _named(df, src, token)
    return named.select(*keep, *[wide.of(df, raw).units(raw, "decimals").alias(out) for raw, out in columns.items()])


# --- ledger layers -----------------------------------------------------------------------

def transfers(src, token):
    """Transfers of the token with amounts in token units."""
    return _in_units(ledger(src, token), src, token, {"raw": "value_token"}, [
        "datetime", "date", "tx_hash", "token_ca", "token_symbol", "from_address", "to_address"])


def trades(src, token):
    """DEX trades as buys and sells of the token, sinks removed (R2)."""
    return flows.exclude_addresses(flows.orient_trades(src.table("dex_trades"), token))


def balance(src, token, gaps="carry"):
    """Balance of every address on every day (R3). The one report whose size is the grid."""
    grid = _raw_balance(src, token, gaps)
    named, number = _named(grid, src, token), wide.of(grid, "balance")
    filled = F.col("balance").isNotNull()
    return named.select(
        "date", F.when(filled, F.col("token_ca")).alias("token_ca"),
        F.when(filled, F.col("token_symbol")).alias("token_symbol"), "address",
        number.units("balance", "decimals").alias("balance_token"))


def store_balances(src, token, store):
    """Extend a ``BalanceStore`` of the token to ``as_of``, reading only events of days that it lacks."""
    def legs(since):
        rows = ledger(src, token)
        if since is not None:  # on the time itself, so that the cut reaches the scan
            rows = rows.filter(F.col("datetime") >= F.lit(since))
        return flows.signed_flows(wide.amounts(rows), "raw", pre_aggregate=False)

    return store.append(legs, src.as_of)


def _shown(df, src, token, *keys):
    number = wide.of(df, "balance")
    return _named(df, src, token).select(
        *keys, "token_ca", "token_symbol", "address", number.units("balance", "decimals").alias("balance_token"))


def balance_from_store(src, token, store):
    """R3 up to ``as_of`` from stored intervals, without the ledger."""
    return _shown(store.daily(src.as_of), src, token, "date")


def balance_on_day(src, token, day, store):
    """Balance of every address on one day (R3 of that day) from stored intervals; no other day is expanded."""
    return _shown(store.on_day(day), src, token).withColumn("date", F.lit(day).cast("date"))


def price_daily(src, token):
    """Closing price of each day of the token's life."""
    close = _close(src, token).select(
        "date", F.col("contract_address").alias("token_ca"), F.col("symbol").alias("token_symbol"),
        "close_price")
    days = spines.date_spine(_days(src, token), "date", src.today)
    return days.join(F.broadcast(close), "date", "left")


def holders(src, token):
    """Who owns the token now (R5): the sum of each address's flows, no calendar."""
    owned = _owned(src, token)
    return _named(owned, src, token).select(
        "token_ca", "token_symbol", "address", wide.of(owned, "balance").units("balance", "decimals").alias("balance_token"))


def _owned(src, token):
    """Positive balances of today; with a store, the view ``holders``."""
    def build():
        stored = _stored_net(src, token)
        if stored is None:
            totals = flows.signed_limbs(ledger(src, token), "raw").groupBy("address").agg(
                *[F.sum(n).alias(n) for n in wide.LIMBS])
            totals = wide.gathered(totals, "balance")
        else:
            totals = balances.current_totals(stored, amount="net_amount")
        return flows.exclude_addresses(totals.filter(wide.of(totals, "balance").above_zero("balance")))

    if not isinstance(src.layers, LayerStore):
        return build()
    return src.view("holders", token, _LEDGER, build)


def supply_mint_burn(src, token, gaps="carry"):
    """Supply, mint and burn per day.

    With carried balances these are running sums of daily flows: one aggregate per day.
    """
    if gaps == "sparse":
        grid = _raw_balance(src, token, gaps).withColumn(
            "token_ca", F.when(F.col("balance").isNotNull(), F.lit(token)))
        split = stats.supply_mint_burn(grid, keys=("date", "token_ca"))
        known = F.col("token_ca").isNotNull()
        named = _named(split.withColumn("_known", known), src, token)
        return named.select(
            "date", F.when(F.col("_known"), F.col("token_ca")).alias("token_ca"),
            F.when(F.col("_known"), F.col("token_symbol")).alias("token_symbol"), *[
                wide.of(split, m).units(m, "decimals").alias(m) for m in ("total_supply", "total_mint", "total_burn")])
    measures = ("total_supply", "total_mint", "total_burn")
    return _in_units(_supply_raw(src, token), src, token, {m: m for m in measures},
                     ["date", "token_ca", "token_symbol"])


def _supply_raw(src, token):
    measures = ("total_supply", "total_mint", "total_burn")
    per_day = stats.supply_mint_burn(_moves(src, token), "transfer_amount")
    return balances.daily_totals(per_day, src.today, measures, null_if_never=measures)


# --- portfolio overlap -------------------------------------------------------------------

def overlap_erc20(src, token, drop_unpriced=False):
    """Other tokens that holders of the token own, with their value.

    Flows are cut to the holders before the shuffle when those are few, and always summed
    per (contract, address) before they are joined. Amounts of any width are exact, so one
    token of absurd amounts neither ends the report nor leaves holders of rounding errors.
    Contracts are counted and broadcast while few: every holder owns the token itself, and a
    shuffle by contract would bring all of them into one task.
    """
    rows = src.table("erc20_transfers").filter(
        F.col("evt_tx_hash").isNotNull() & F.col("from").isNotNull() & F.col("to").isNotNull())
    who = materialise(holders(src, token).select("token_ca", "token_symbol", "address"))
    sides = rows.select("contract_address", "value", F.inline(F.array(
        F.struct(F.col("to").alias("address"), F.lit(1).alias("_sign")),
        F.struct(F.col("from").alias("address"), F.lit(-1).alias("_sign")))))
    legs = flows.narrow_to(sides, "address", who, src.broadcast_rows)  # before any amount is looked at
    parts = wide.limbs("value", legs.schema["value"].dataType)
    owned = legs.groupBy("contract_address", "address").agg(*[
        F.sum(F.when(F.col("_sign") > 0, x).otherwise(-x)).alias(n) for n, x in parts.items()]).filter(
        wide.is_positive(*wide.LIMBS))
    known = flows.token_info(src.table("tokens_erc20")).select(
        F.col("token_ca").alias("contract_address"), F.col("token_symbol").alias("symbol"), "decimals")
    # Contracts are joined among themselves first, so holdings meet them in a single join.
    priced = known.join(prices.latest_price(src.table("prices_usd")), "contract_address",
                        "inner" if drop_unpriced else "left")
    priced = materialise(priced)
    if flows.fits_broadcast(priced):
        priced = F.broadcast(priced)
    return (who.join(owned, "address").join(priced, "contract_address")
            .withColumn("balance_token", wide.as_units(*wide.LIMBS, "decimals"))
            .select("token_ca", "token_symbol", "address", "contract_address", "symbol",
                    "balance_token", (F.col("balance_token") * F.col("last_price")).alias("balance_usd")))


def native_totals(src, who=None):
    """Wei received, sent and burnt as gas per address, from one pass over traces and fees.

    ``who`` is the set of addresses the totals are needed for, if not all.
    """
    none = F.lit(None).cast("decimal(38,0)")
    calls = flows.value_calls(src.table("traces"))
    legs = calls.select(F.inline(F.array(
        F.struct(F.col("to").alias("address"), F.col("value").alias("wei_in"), none.alias("wei_out")),
        F.struct(F.col("from").alias("address"), none.alias("wei_in"), F.col("value").alias("wei_out")),
    ))).withColumn("wei_gas", none)
    gas = src.table("gas_fees")
    if "block_time" not in gas.columns:  # fees without a time are cut by their transactions
        gas = gas.join(src.table("traces").select("tx_hash").distinct(), "tx_hash", "left_semi")
    fees = flows.gas_cost(gas).select(
        F.col("tx_sender").alias("address"), none.alias("wei_in"), none.alias("wei_out"),
        F.col("gas_wei").alias("wei_gas"))
    events = legs.unionByName(fees)
    if who is not None:
        events = flows.narrow_to(events, "address", who, src.broadcast_rows)
    return events.groupBy("address").agg(*[F.sum(m).alias(m) for m in ("wei_in", "wei_out", "wei_gas")])


def overlap_eth(src, token):
    """Native coin owned by holders of the token (R8). Only value of calls is counted."""
    who = materialise(holders(src, token).select("token_ca", "token_symbol", "address"))
    owned = stats.current_balance(who, native_totals(src, who), "wei_in", ["wei_out", "wei_gas"],
                                  out="wei", positive=True)
    return owned.select("token_ca", "token_symbol", "address",
                        scaled("wei", WEI_DECIMALS).alias("balance_eth"))


def other_coins_eth(src, token):
    """Holders ordered by the native coin they own."""
    who = materialise(holders(src, token).select("address"))
    owned = stats.current_balance(who, native_totals(src, who), "wei_in", ["wei_out", "wei_gas"], out="wei")
    placed = ranking.cumulative_position(
        owned, [ranking.ascending("wei"), ranking.ascending("address")])
    return placed.select(
        "address_idx_cumulative_dist", "address_idx", "address",
        scaled("wei_in", WEI_DECIMALS).alias("eth_in"),
        scaled("wei_out", WEI_DECIMALS).alias("eth_out"),
        scaled("wei_gas", WEI_DECIMALS).alias("gas_spent"),
        scaled(F.round("wei", 8 - WEI_DECIMALS), WEI_DECIMALS).alias("balance_eth"),
    )


def other_coins_erc20(src, token, other):
    """Holders ordered by how much of another token they own."""
    rows = src.table("erc20_transfers").filter(
        (F.col("contract_address") == other) & F.col("evt_tx_hash").isNotNull()
        & F.col("from").isNotNull() & F.col("to").isNotNull())
    who = materialise(holders(src, token).select("address"))
    legs = flows.narrow_to(flows.signed_flows(
        wide.amounts(rows.select(F.to_date("evt_block_time").alias("date"), F.col("from").alias("from_address"),
                                 F.col("to").alias("to_address"), "value"), "value"),
        "value", pre_aggregate=False), "address", who, src.broadcast_rows)
    decimals = _token_row(src, other).agg(F.max("decimals").alias("d")).scalar()
    ticks = src.table("prices_usd").filter(F.col("contract_address") == other)
    price = prices.latest_price(ticks, by=()).select("last_price").scalar()
    totals = balances.current_totals(legs)
    owned = who.join(totals, "address", "left").withColumn(
        "balance", zero_if_null(wide.of(totals, "balance").units("balance", decimals)))
    placed = ranking.cumulative_position(
        owned, [ranking.ascending("balance"), ranking.ascending("address")])
    return placed.select(
        "address_idx_cumulative_dist", "address_idx", "address",
        F.round("balance", 8).alias("balance_token"),
        F.round(zero_if_null(F.col("balance") * price), 2).alias("balance_usd"))


# --- holders and activity ----------------------------------------------------------------

def active_addresses(src, token):
    """Senders and receivers per day and in the trailing 7 and 30 days."""
    counts = activity.rolling_distinct(
        ledger(src, token), {"from": "from_address", "to": "to_address"},
        {"dau": 1, "wau": 7, "mau": 30}, src.today)
    return counts.orderBy("date")


def store_activity(src, token, store):
    """Extend an ``ActivityStore`` of the token's senders and receivers to ``as_of``."""
    def events(since):
        rows = ledger(src, token)
        return rows if since is None else rows.filter(F.col("datetime") >= F.lit(since))

    return store.append(events, {"from": "from_address", "to": "to_address"}, src.as_of)


def active_addresses_from_store(src, store, since=None):
    """R9 from stored days; with ``since``, for the days from then on alone."""
    return store.rolling({"dau": 1, "wau": 7, "mau": 30}, ("from", "to"), src.as_of, since).orderBy("date")


def avg_purchase_price(src, token):
    """Holders ordered by what they paid on average."""
    decimals = _token_row(src, token).select("decimals").scalar()
    paid = stats.avg_purchase_price(
        _legs(src, token, label=True), F.broadcast(_close(src, token)), decimals)
    kept = flows.exclude_addresses(paid).filter(
        (F.col("balance_token") > 0) & F.col("avg_purchase_price_usd").isNotNull())
    placed = ranking.cumulative_position(
        kept, [ranking.ascending("avg_purchase_price_usd"), ranking.ascending("address")])
    return placed.select("address_idx", "balance_token", "avg_purchase_price_usd",
                         "address_idx_cumulative_dist")


def current_holders(src, token, gaps="carry"):
    """Number of holders per day; days without any are left out."""
    active = flows.exclude_addresses(_active(src, token))
    holds = wide.of(active, "balance").above_zero
    if gaps == "sparse":
        counts = (active.filter(holds("balance")).groupBy("date")
                  .agg(F.count("address").alias("holders_cnt")))
    else:
        moves = active.select("date", (holds("balance").cast("long")
                                       - holds("prev_balance").cast("long")).alias("holders_cnt"))
        counts = balances.daily_totals(moves, src.today, ["holders_cnt"]).filter("holders_cnt > 0")
    return counts.orderBy("date")


def _new_holders(src, token, period, out, gaps, first_time_only):
    if gaps == "sparse":
        grid = flows.exclude_addresses(_raw_balance(src, token, gaps))
        counts = activity.new_holders(grid, period, out, first_time_only=first_time_only)
    else:
        active = flows.exclude_addresses(_active(src, token))
        counts = activity.new_holders_from_active(
            active, src.today, period, out, first_time_only=first_time_only)
    return counts.orderBy(period)


def new_holders_daily(src, token, gaps="carry", first_time_only=False):
    """Addresses that hold today and did not yesterday."""
    counts = _new_holders(src, token, "day", "dnu", gaps, first_time_only)
    return counts.withColumnRenamed("day", "date")


def new_holders_weekly(src, token, gaps="carry", first_time_only=False):
    """Addresses that hold this week and did not last week."""
    return _new_holders(src, token, "week", "wnu", gaps, first_time_only)


def new_holders_monthly(src, token, gaps="carry", first_time_only=False):
    """Addresses that hold this month and did not last month."""
    return _new_holders(src, token, "month", "mnu", gaps, first_time_only)


def top_holders_list(src, token, n=10):
    """The largest holders and their share of all holdings."""
    shares = ranking.share_of_total(holders(src, token), "balance_token")
    return ranking.top_n(
        shares, [ranking.descending("balance_token"), ranking.ascending("address")], n)


# --- wealth gap --------------------------------------------------------------------------

def _population(per_address):
    """How many addresses, sinks aside, ever took part."""
    everyone = flows.exclude_addresses(per_address.select("address").distinct())
    return everyone.agg(F.count(F.lit(1)).alias("n")).scalar()


def _sender_tops(src, token, measure, value, n, fill):
    """Top senders per day. Days and addresses without activity add labels, not rows.

    One pass yields a row per day and address: senders with their measure, receivers only
    to be counted among the population.
    """
    legs = flows.signed_flows(
        _amounts(src, token), "raw", keys=("tx_hash",), pre_aggregate=False, label=True)
    sent, number = F.col("transfer_type") == "sell", wide.of(legs, "transfer_amount")
    amount = F.when(sent, F.col("tx_hash") if value == "count" else number.negative("transfer_amount"))
    total = F.count(amount) if value == "count" else number.total(amount)
    per = legs.groupBy("date", "address").agg(total.alias(measure), F.count(F.when(sent, 1)).alias("_sent"))
    number = wide.of(per, measure)
    per = materialise(number.settled(per, measure))
    own = not_sink("address") & (F.col("_sent") > 0)
    days = number.settled(per.groupBy("date").agg(
        number.total(F.when(own, F.col(measure))).alias("_all"),
        F.count(F.when(own, F.col(measure))).alias("_filled")), "_all")
    days = spines.fill_days(days, src.today, on_day=["_all", "_filled"], absent={"_filled": 0})
    top = ranking.top_ranks(per.filter(own), measure, n=n)
    return ranking.label_tops(top, days, _population(per), measure, n=n, fill=fill)


def wealth_gap_txs(src, token, n=10):
    """Transfers sent per day by each of the ten busiest senders and by all others."""
    tops = _sender_tops(src, token, "txs_cnt", "count", n, fill=0)
    return tops.orderBy("date", "top10")


def wealth_gap_volume(src, token, n=10):
    """Volume sent per day by each of the ten largest senders and by all others."""
    tops = _sender_tops(src, token, "raw_volume", "sum", n, fill=None)
    return _in_units(tops, src, token, {"raw_volume": "tx_volume_token"},
                     ["date", "top10"]).orderBy("date", "top10")


def wealth_gap_balance(src, token, gaps="carry", n=10):
    """Balance per day of each of the ten largest holders and of all others.

    Only positive balances that can be among the ten largest of a day are expanded to days.
    Zeros fill the ranks behind them, and balances below zero are looked at only on days on
    which hardly anybody stands above. The rest is the day's total less its top, and the
    totals come from the daily flows.
    """
    if gaps == "sparse":
        grid = flows.exclude_addresses(_raw_balance(src, token, gaps))
        tops = ranking.topn_with_others(grid, "balance", n=n)
    else:
        net = _net(src, token)
        people = _population(net)
        owners, first = flows.exclude_addresses(net), spines.first_day(net)
        near = balances.top_balances(owners, first, src.today, n)
        # Days on which only sinks moved still belong to the calendar.
        own = F.when(not_sink("address"), F.col("net_amount")).otherwise(wide.of(net, "net_amount").zero)
        days = balances.daily_totals(
            net.select("date", own.alias("_all")), src.today, ["_all"]).withColumn("_filled", people)
        above = ranking.top_ranks(near, "balance", n=n).select("date", "address", "balance", "rank")
        poor = balances.sign_counts(owners, src.today).withColumn(
            "_nonnegative", people - F.col("_below")).filter(F.col("_nonnegative") < n).select("date", "_nonnegative")
        below = balances.lowest_balances(owners, first, src.today, poor, n)
        # what no row of a rank stands for is an address that holds nothing
        tops = ranking.label_tops(above.unionByName(below), days, people, "balance", n=n, fill=0)
    return _in_units(tops, src, token, {"balance": "balance_token"},
                     ["date", "top10"]).orderBy("date", "top10")


def _latest_labels(tops):
    return ranking.latest_per_key(tops, ["top10"]).orderBy("date", "top10")


def wealth_gap_txs_today(src, token, n=10):
    """Latest day of each label of R18."""
    return _latest_labels(wealth_gap_txs(src, token, n))


def wealth_gap_balance_today(src, token, gaps="carry", n=10):
    """Latest day of each label of R20."""
    return _latest_labels(wealth_gap_balance(src, token, gaps, n))


def wealth_gap_volume_today(src, token, n=10):
    """Latest day of each label of R22."""
    return _latest_labels(wealth_gap_volume(src, token, n))


# --- markets -----------------------------------------------------------------------------

def _by_volume(df):
    keys = [c for c in df.columns if not c.startswith(("tx_", "trader", "addresses"))]
    return df.orderBy(ranking.descending("tx_volume_usd_buy"),
                      ranking.descending("tx_volume_usd_sell"), *[ranking.ascending(c) for c in keys])


def dex_dominance_by_platform(src, token):
    """Buys and sells of the token per DEX."""
    return _by_volume(stats.trade_measures(trades(src, token), ["project"]))


def dex_pairs_by_symbol(src, token):
    """Buys and sells of the token per counter token."""
    return _by_volume(stats.trade_measures(
        trades(src, token), ["counter_token_symbol", "counter_token_ca"], addresses=False))


def _on_calendar(src, token, daily):
    """Every day of the token's life, also those without a trade (counts are then zero)."""
    days = spines.date_spine(_days(src, token), "date", src.today)
    joined = days.join(daily, "date", "left")
    return joined.select(*[zero_if_null(c).alias(c) if "_cnt_" in c else F.col(c)
                           for c in joined.columns]).orderBy("date")


def dex_dominance_daily(src, token):
    """R24 per day, sells negated."""
    daily = stats.trade_measures(trades(src, token), ["date", "project"], negate_sell=True)
    return _on_calendar(src, token, daily)


def dex_pairs_daily(src, token):
    """R26 per day, sells negated."""
    daily = stats.trade_measures(
        trades(src, token), ["date", "counter_token_symbol", "counter_token_ca"],
        addresses=False, negate_sell=True)
    return _on_calendar(src, token, daily)


# --- overview ----------------------------------------------------------------------------

def marketcap(src, token, gaps="carry"):
    """Closing price times circulating supply."""
    supply = supply_mint_burn(src, token, gaps)
    if gaps == "sparse":
        # Days on which nothing moved have no supply but still a place in the calendar.
        supply = supply.groupBy("date").agg(
            F.max(F.when(F.col("token_ca").isNotNull(), F.col("total_supply"))).alias("total_supply"))
    close = F.broadcast(_close(src, token).select("date", "close_price"))
    value = zero_if_null("close_price") * zero_if_null("total_supply")
    return (supply.join(close, "date", "left")
            .select("date", value.alias("marketcap")).orderBy("date"))


def price_with_ma(src, token, exact=False):
    """Closing price with trailing means (R29); see ``moving_average`` for window lengths."""
    windows = {"ma_5d": 5, "ma_10d": 10, "ma_20d": 20, "ma_60d": 60}
    return prices.moving_average(
        price_daily(src, token), "close_price", windows, exact=exact).orderBy("date")


def volume(src, token):
    """Transactions and volume per day, valued at the close."""
    moved = _amounts(src, token)
    number = wide.of(moved, "raw")
    daily = number.settled(moved.groupBy("date").agg(
        F.count_distinct("tx_hash").alias("txs_cnt"), number.total("raw").alias("raw_volume")), "raw_volume")
    daily = spines.fill_days(daily, src.today, on_day=["txs_cnt", "raw_volume"],
                             absent={"txs_cnt": 0})
    daily = _in_units(daily, src, token, {"raw_volume": "volume_token"}, ["date", "txs_cnt"])
    close = F.broadcast(_close(src, token).select("date", "close_price"))
    return prices.attach_usd(daily, close, amount="volume_token", out="volume_usd").orderBy("date")


def tokenomics(src, token, gaps="carry"):
    """Supply, mint and burn in date order."""
    return supply_mint_burn(src, token, gaps).orderBy("date")
