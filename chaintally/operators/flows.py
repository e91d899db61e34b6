"""From raw events to signed flows per address."""

from __future__ import annotations

from functools import reduce
from itertools import zip_longest
from operator import and_

from pyspark.sql import functions as F

from chaintally.constants import GWEI_DECIMALS, SINK_ADDRESSES, VALUELESS_CALL_TYPES, WEI_DECIMALS
from chaintally.functions import wide
from chaintally.functions.columns import not_sink, scaled, zero_if_null
from chaintally.session import materialise

# A row of an address set or of token metadata takes some 100 bytes, so this many take well
# under 100 MB on an executor.
BROADCAST_ROWS = 500_000
# Bits of the filter that stands in for a larger address set, at most: 2 ** 20 rows of 64 bits are sent around,
# whatever the set. It lets through every address of the set and, up to 8 million of them, one in eight others.
FILTER_BITS = 1 << 26
# Pairs of ids and values that one task compares.
PAIRS = 1_000_000


def token_info(meta, chain=None):
    """Exactly one metadata row per contract (T2); a second row would double its transfers."""
    if chain is not None:
        meta = meta.filter(F.col("blockchain") == chain)
    info = F.struct("symbol", "decimals")
    order = F.struct(F.col("symbol").isNull(), "symbol", "decimals")
    return (meta.groupBy(F.col("contract_address").alias("token_ca"))
            .agg(F.min_by(info, order).alias("info"))
            .select("token_ca", F.col("info.symbol").alias("token_symbol"), "info.decimals"))


def scale_amount(df, meta, raw="value", out="value_token", max_rows=BROADCAST_ROWS):
    """Attach metadata and express ``raw`` in token units; unknown tokens get NULL.

    Metadata is counted and broadcast while small, so that a token with a third of all
    transfers stays spread as it was read. Larger metadata is sort-merged, with AQE
    splitting the partitions of heavy tokens.
    """
    meta = materialise(meta)
    if fits_broadcast(meta, max_rows):
        meta = F.broadcast(meta)
    return (df.join(meta, df["contract_address"] == meta["token_ca"], "left")
            .drop("token_ca").withColumn(out, scaled(raw, "decimals")))


def account_transfers(df, account, from_col="from", to_col="to", tx_col=None):
    """Rows that touch ``account``, seen from its side.

    A transfer to oneself counts as outgoing, because the sender is tested first.
    """
    sender, receiver = F.col(from_col), F.col(to_col)
    df = df.filter((sender == account) | (receiver == account))
    if tx_col:
        df = df.filter(F.col(tx_col).isNotNull() & sender.isNotNull() & receiver.isNotNull())
    outgoing = F.coalesce(sender == account, F.lit(False))
    return (df.withColumn("ca_address", F.lit(account))
            .withColumn("transfer_type", F.when(outgoing, "from").otherwise("to"))
            .withColumn("counter_address", F.when(outgoing, receiver).otherwise(sender)))


def explode_batch(df, ids="ids", values="values", pairing="zip"):
    """One row per item of a batch transfer (T4).

    ``zip`` pairs the n-th id with the n-th value. ``cross`` combines every id with every
    value of the same event and removes duplicates, as some published figures do. Ids and values
    are made distinct inside their event, so an event of one batch has no duplicates left and is
    unfolded where it is; only the pairs of events that have several batches are compared.
    """
    rest = [c for c in df.columns if c not in (ids, values)]
    if pairing == "zip":
        pairs = F.arrays_zip(F.col(ids).alias("id"), F.col(values).alias("value"))
        return df.select(*rest, F.inline(pairs)).toDF(*rest, "id", "value")

    def unfolded(batches):
        one = batches.select(*rest, F.explode("_ids").alias("id"), "_values")
        return one.select(*rest, "id", F.explode("_values").alias("value"))

    batches = materialise(df.select(
        *rest, F.array_distinct(ids).alias("_ids"), F.array_distinct(values).alias("_values")).distinct())
    several = materialise(batches.groupBy(*rest).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    if several.isEmpty():
        return unfolded(batches)
    same = reduce(and_, [batches[c].eqNullSafe(several[c]) for c in rest], F.lit(True))
    shared = materialise(batches.join(several, same, "left_semi"))
    pairs = shared.agg(F.sum(F.size("_ids").cast("long") * F.size("_values"))).first()[0]
    parts = unfolded(shared).repartition(1 + max(0, pairs or 0) // PAIRS, *rest, "id", "value")
    return unfolded(batches.join(several, same, "left_anti")).unionByName(parts.distinct())


def value_calls(traces, require_positive=True):
    """Successful calls that can move the native coin (T5)."""
    kind = F.col("call_type")
    traces = traces.withColumn("value", F.col("value").cast("decimal(38,0)"))  # coin amounts fit
    calls = traces.filter(
        (F.col("type") == "call")
        & (kind.isNull() | ~kind.isin(*VALUELESS_CALL_TYPES))
        & F.col("success"))
    return calls.filter(F.col("value") > 0) if require_positive else calls


def gas_cost(gas):
    """Fee of each transaction, exact in wei and as a display amount."""
    wei_price = F.round(F.col("gas_price_gwei") * F.lit(10.0 ** GWEI_DECIMALS))
    fee = wei_price.cast("decimal(20,0)") * F.col("gas_used").cast("decimal(18,0)")
    return gas.withColumn("gas_wei", fee.cast("decimal(38,0)")).withColumn(
        "gas_eth", scaled("gas_wei", WEI_DECIMALS))


def signed_flows(transfers, amount, keys=(), pre_aggregate=True, label=False,
                 from_col="from_address", to_col="to_address"):
    """Each transfer as +amount for its receiver and -amount for its sender.

    One pass over the transfers: both legs come from an array, so the source is read once.
    """
    number = wide.of(transfers, amount)
    legs = F.array(
        F.struct(F.col(to_col).alias("address"), F.lit("buy").alias("transfer_type"),
                 F.col(amount).alias("transfer_amount")),
        F.struct(F.col(from_col).alias("address"), F.lit("sell").alias("transfer_type"),
                 number.negative(amount).alias("transfer_amount")))
    flows = transfers.select("date", *keys, F.inline(legs))
    if pre_aggregate:
        flows = number.settled(flows.groupBy("date", *keys, "address", "transfer_type").agg(
            number.total("transfer_amount").alias("transfer_amount")), "transfer_amount")
    return flows if label else flows.drop("transfer_type")


def signed_limbs(transfers, amount, keys=(), from_col="from_address", to_col="to_address"):
    """``signed_flows`` for amounts of any width: one column per limb."""
    parts = wide.limbs(amount, transfers.schema[amount].dataType)
    legs = F.array(*[F.struct(F.col(c).alias("address"), *[(sign * x).alias(n) for n, x in parts.items()])
                     for c, sign in ((to_col, F.lit(1)), (from_col, F.lit(-1)))])
    return transfers.select("date", *keys, F.inline(legs)).withColumns(
        {n: F.col(n).cast("decimal(38,0)") for n in wide.LIMBS})


def net_flows(flows, keys=("date", "address"), amount="transfer_amount", out="net_amount"):
    """Sum of the signed flows per key.

    Grouping includes the day, and partial sums are taken before the shuffle, so an address
    that takes part in a third of all transfers becomes at most one row per day and task.
    """
    number = wide.of(flows, amount)
    return number.settled(flows.groupBy(*keys).agg(number.total(amount).alias(out)), out)


def in_out_by_date(transfers, measures, keys=(), out_only=()):
    """Daily incoming and outgoing sums of one account, and their difference.

    ``measures`` are split by direction into ``<m>_in`` and ``<m>_out``; ``out_only``
    columns, such as gas, are charged only on outgoing rows, each once: the n-th one to the
    n-th measure.
    """
    incoming, outgoing = F.col("transfer_type") == "to", F.col("transfer_type") == "from"
    aggs = []
    for m in measures:
        aggs += [F.sum(F.when(incoming, F.col(m))).alias(f"{m}_in"),
                 F.sum(F.when(outgoing, F.col(m))).alias(f"{m}_out")]
    aggs += [F.sum(F.when(outgoing, F.col(m))).alias(m) for m in out_only]
    daily = transfers.groupBy("date", *keys).agg(*aggs)
    for m, fee in zip_longest(measures, out_only):
        net = zero_if_null(f"{m}_in") - zero_if_null(f"{m}_out")
        if fee is not None:
            net = net - zero_if_null(fee)
        daily = daily.withColumn(f"{m}_net", net)
    return daily


def exclude_addresses(df, column="address", addresses=SINK_ADDRESSES):
    """Drop addresses that belong to nobody; rows without an address go too."""
    return df.filter(not_sink(column, addresses))


def fits_broadcast(df, max_rows=BROADCAST_ROWS):
    """Whether a frame of short rows is small enough to send to every executor."""
    return df.count() <= max_rows


def restrict_to(df, column, holders, holder_column="address", max_rows=BROADCAST_ROWS):
    """Keep rows whose ``column`` is in the holder set.

    A counted, small set is broadcast and ``df`` is filtered where it is scanned. For a larger
    one the filter of the set goes first, and the rows that pass it are joined by shuffle,
    where AQE splits the partitions of very active addresses.
    """
    wanted = materialise(holders.select(F.col(holder_column).alias(column)).distinct())
    count = wanted.count()
    if count <= max_rows:
        return df.join(F.broadcast(wanted), column, "left_semi")
    return pass_filter(df, column, address_filter(wanted, column, count)).join(wanted, column, "left_semi")


def narrow_to(df, column, holders, max_rows=BROADCAST_ROWS):
    """Drop rows a later join to ``holders`` would drop anyway, without a shuffle.

    ``holders`` should be materialised, because it is counted here and joined later. A small
    set is broadcast. Of a larger one only a filter of bounded size is, which is applied in
    the scan and lets some strangers through; the later join drops those. So the rows that
    are aggregated are those of the holders, and the filter's errors, at any size of the set.
    """
    count = holders.count()
    if count <= max_rows:
        return df.join(F.broadcast(holders.select(F.col("address").alias(column))), column, "left_semi")
    return pass_filter(df, column, address_filter(holders, "address", count))


def _spot(column, bits):
    return F.xxhash64(column).bitwiseAND(F.lit(bits - 1))


def address_filter(addresses, column, count, most=None):
    """(word, mask, bits): a bit for the hash of every address, 64 to a row, as a stored table.

    Bits of a word are united on the map side, so the table has at most ``bits / 64`` rows
    and each task sends at most that many.
    """
    bits = max(1 << 10, min(most or FILTER_BITS, 1 << (8 * count).bit_length()))
    spot = _spot(column, bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))
    words = addresses.select(F.call_function("shiftright", spot, F.lit(6)).alias("_word"), one.alias("_bit"))
    return materialise(words.groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))), bits


def pass_filter(df, column, table):
    """Rows whose ``column`` may be in the set of an ``address_filter``."""
    masks, bits = table
    marked = df.withColumn("_spot", _spot(column, bits)).withColumn("_word", F.call_function("shiftright", "_spot", F.lit(6)))
    hit = F.call_function("shiftrightunsigned", F.col("_mask"), F.col("_spot").bitwiseAND(F.lit(63)).cast("int"))
    return marked.join(F.broadcast(masks), "_word").filter(hit.bitwiseAND(F.lit(1)) == 1).drop("_spot", "_word", "_mask")


def orient_trades(trades, token):
    """Trades of ``token`` as buys and sells, with the other side as counter token."""
    bought = F.col("token_bought_address") == token
    sold = F.col("token_sold_address") == token

    def side(field, own):
        buy, sell = ("bought", "sold") if own else ("sold", "bought")
        return F.when(bought, F.col(f"token_{buy}_{field}")).otherwise(F.col(f"token_{sell}_{field}"))

    return (trades
            .filter(F.col("token_bought_address").isNotNull()
                    & F.col("token_sold_address").isNotNull()
                    & (bought | sold)
                    & F.col("tx_hash").isNotNull() & F.col("tx_from").isNotNull())
            .select(F.col("block_date").alias("datetime"), F.to_date("block_date").alias("date"),
                    F.when(bought, "buy").otherwise("sell").alias("trade_type"),
                    "project", "tx_hash", F.col("tx_from").alias("address"),
                    F.lit(token).alias("token_ca"), side("symbol", True).alias("token_symbol"),
                    side("amount", True).alias("amount_token"), "amount_usd",
                    side("address", False).alias("counter_token_ca"),
                    side("symbol", False).alias("counter_token_symbol")))
