"""Reports about one account or contract: its transfers, balances, users and profile."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from chaintally.constants import WEI_DECIMALS
from chaintally.functions import wide
from chaintally.functions.columns import scaled, zero_if_null
from chaintally.operators import activity, balances, flows, prices, spines, stats
from chaintally.session import materialise


def _account_erc20(src, account):
    rows = flows.account_transfers(src.table("erc20_transfers"), account, tx_col="evt_tx_hash")
    return rows.withColumn("date", F.to_date("evt_block_time"))


def account_transfers_erc20(src, account):
    """Fungible transfers in and out of an account."""
    meta = flows.token_info(src.table("tokens_erc20"))
    rows = flows.scale_amount(_account_erc20(src, account), meta)
    return rows.select(
        F.col("evt_block_time").alias("datetime"), "ca_address", "transfer_type",
        F.col("evt_tx_hash").alias("tx_hash"), "counter_address",
        F.col("contract_address").alias("token_ca"), "token_symbol", "value_token")


def account_transfers_erc721(src, account, oriented=False):
    """Item transfers in and out of an account.

    ``oriented`` adds direction and counterparty as in the fungible report.
    """
    rows = flows.account_transfers(src.table("erc721_transfers"), account, tx_col="evt_tx_hash")
    head = [F.col("evt_block_time").alias("datetime")]
    if oriented:
        return rows.select(*head, "ca_address", "transfer_type", F.col("evt_tx_hash").alias("tx_hash"),
                           "counter_address", F.col("contract_address").alias("token_ca"), "tokenId")
    return rows.select(*head, F.col("evt_tx_hash").alias("tx_hash"), F.col("from").alias("from_address"),
                       F.col("to").alias("to_address"), "contract_address", "tokenId")


def account_transfers_erc1155(src, account, pairing="zip"):
    """Single and batch multi-token transfers in and out of an account.

    Batches are filtered to the account before they are unfolded.
    """
    def shaped(name, kind):
        rows = flows.account_transfers(src.table(name), account, tx_col="evt_tx_hash")
        head = [F.col("evt_block_time").alias("datetime"), F.lit(kind).alias("transfer_type"),
                F.col("evt_tx_hash").alias("tx_hash"), F.col("from").alias("from_address"),
                F.col("to").alias("to_address"), "contract_address"]
        body = ("ids", "values") if kind == "batch" else ("id", "value")
        return rows.select(*head, *body)

    single = shaped("erc1155_single", "single")
    batch = flows.explode_batch(shaped("erc1155_batch", "batch"), pairing=pairing)
    return single.unionByName(batch)


def _account_eth(src, account, gas):
    """Calls that touch the account, in wei, with the fee of their transaction.

    ``per_tx`` shows the fee on one outgoing row per transaction; ``per_trace`` repeats it
    on every row, which counts a fee once per internal call.
    """
    calls = flows.account_transfers(flows.value_calls(src.table("traces"), False), account)
    calls = materialise(calls)  # few rows; the fee table is cut to their transactions
    gas_rows = flows.restrict_to(src.table("gas_fees"), "tx_hash", calls, "tx_hash")
    fees = flows.gas_cost(gas_rows).select("tx_hash", "gas_wei")
    if gas == "per_tx":
        outgoing = F.col("transfer_type") == "from"
        w = W.partitionBy("tx_hash", "transfer_type").orderBy(
            F.col("block_time").asc_nulls_last(), F.col("counter_address").asc_nulls_last(),
            F.col("value").asc_nulls_last(), F.col("input").asc_nulls_last())
        calls = calls.withColumn("_charged", outgoing & (F.row_number().over(w) == 1))
    else:
        calls = calls.withColumn("_charged", F.lit(True))
    return (calls.join(fees, "tx_hash", "left")
            .withColumn("date", F.to_date("block_time"))
            .withColumn("gas_wei", F.when(F.col("_charged"), F.col("gas_wei"))))


def account_transfers_eth(src, account, gas="per_tx"):
    """Native coin transfers in and out of an account with fees."""
    return _account_eth(src, account, gas).select(
        F.col("block_time").alias("datetime"), "ca_address", "transfer_type", "tx_hash",
        "counter_address", scaled("value", WEI_DECIMALS).alias("value_eth"),
        scaled("gas_wei", WEI_DECIMALS).alias("gas_eth"), F.col("input").alias("data"))


def account_balance_erc20(src, account, drop_unpriced=False):
    """Daily balance of every token the account touched, with its value.

    Amounts of any width are netted per (token, day) before metadata and prices are joined;
    of the price ticks only those of the account's tokens and days are read on. Days before a
    token first moved have no balance.
    """
    rows = _account_erc20(src, account)
    net = materialise(flows.in_out_by_date(
        rows.withColumns(wide.limbs("value")), list(wide.LIMBS), keys=("contract_address",)))
    daily = balances.running_balance(
        net, spines.first_day(net), src.today, keys=("contract_address",),
        measures=tuple(f"{n}_net" for n in wide.LIMBS), out={f"{n}_net": n for n in wide.LIMBS}, before_first=None)
    meta = flows.token_info(src.table("tokens_erc20")).select(
        F.col("token_ca").alias("contract_address"), F.col("token_symbol").alias("symbol"), "decimals")
    named = daily.join(meta, "contract_address", "left").select(
        "date", "contract_address", "symbol", wide.as_units(*wide.LIMBS, "decimals").alias("balance_token"))
    ticks = src.table("prices_usd").filter(F.col("minute") >= spines.first_day(net))
    close = prices.daily_close(flows.restrict_to(ticks, "contract_address", net, "contract_address"))
    return prices.attach_usd(named, close, on=("date", "contract_address"),
                             drop_unpriced=drop_unpriced).select(
        "date", "contract_address", "symbol", "balance_token", "balance_usd")


def account_balance_erc721(src, account):
    """Daily number of items of every collection the account touched."""
    rows = account_transfers_erc721(src, account, oriented=True).select(
        F.to_date("datetime").alias("date"), "transfer_type",
        F.col("token_ca").alias("contract_address"), F.lit(1).cast("long").alias("items"))
    net = materialise(flows.in_out_by_date(rows, ["items"], keys=("contract_address",)))
    daily = balances.running_balance(
        net, spines.first_day(net), src.today, keys=("contract_address",),
        measures=("items_net",), out={"items_net": "balance_token"}, before_first=None)
    labels = src.table("tokens_nft").groupBy("contract_address").agg(F.min("name").alias("symbol"))
    return daily.join(labels, "contract_address", "left").select(
        "date", "contract_address", "symbol", "balance_token")


def account_balance_eth(src, account, gas="per_tx"):
    """Daily native coin balance of the account."""
    rows = _account_eth(src, account, gas)
    net = flows.in_out_by_date(rows, ["value"], out_only=["gas_wei"])
    totals = balances.daily_totals(net.select("date", F.col("value_net").alias("wei")),
                                   src.today, ["wei"])
    return totals.select("date", scaled("wei", WEI_DECIMALS).alias("balance_eth"))


def balance_erc20_view(src, account, drop_unpriced=False):
    """R36 for display: no gaps, unnamed tokens under their address."""
    return account_balance_erc20(src, account, drop_unpriced).select(
        "date", "contract_address", F.coalesce("symbol", "contract_address").alias("symbol"),
        zero_if_null("balance_token").alias("balance_token"),
        zero_if_null("balance_usd").alias("balance_usd")).orderBy("date", "contract_address")


def balance_erc20_total(src, account, drop_unpriced=False):
    """Value of all tokens of the account per day."""
    return (account_balance_erc20(src, account, drop_unpriced).groupBy("date")
            .agg(F.sum("balance_usd").alias("balance_usd")).orderBy("date"))


def balance_eth_view(src, account, gas="per_tx"):
    """R38 in date order."""
    return account_balance_eth(src, account, gas).orderBy("date")


def contract_profile(src, address):
    """What kind of contract this is and who deployed it.

    Ledgers with an index in ``src.zones`` are probed by it; the others are scanned.
    """
    def ledger(name):
        return src.zones[name].holds if name in src.zones else src.table(name)

    return stats.contract_profile(src.table("contracts"), {
        "ERC-20": [ledger("erc20_transfers")],
        "ERC-721": [ledger("erc721_transfers")],
        "ERC-1155": [ledger("erc1155_single"), ledger("erc1155_batch")],
    }, address)


def _callers(src, contract):
    return src.table("traces").filter((F.col("to") == contract) & F.col("success"))


def contract_active_users(src, contract):
    """Callers per day and in the trailing 7 and 30 days."""
    return activity.rolling_distinct(
        _callers(src, contract), {"": "from"}, {"dau": 1, "wau": 7, "mau": 30}, src.today,
        date="block_time").orderBy("date")


def store_callers(src, contract, store):
    """Extend an ``ActivityStore`` of the contract's callers to ``as_of``."""
    def events(since):
        rows = _callers(src, contract)
        return rows if since is None else rows.filter(F.col("block_time") >= F.lit(since))

    return store.append(events, {"": "from"}, src.as_of, at="block_time")


def contract_active_users_from_store(src, store, since=None):
    """R52 from stored days; with ``since``, for the days from then on alone."""
    return store.rolling({"dau": 1, "wau": 7, "mau": 30}, ("",), src.as_of, since).orderBy("date")


def contract_cumulative_users(src, contract):
    """Callers per day and callers ever seen."""
    return activity.cumulative_distinct(
        _callers(src, contract), "from", src.today, date="block_time").orderBy("date")
