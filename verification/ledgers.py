"""Shapes the driver's tables into the ledger's source tables (see FIXTURES.md)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from chaintally import Sources
from chaintally.constants import DEAD_ADDRESS, ZERO_ADDRESS

EVENT_DAY = dt.date(2024, 1, 31)
ORDER_DAY = dt.date(2001, 12, 31)

TOKEN, OTHER_TOKEN = "click", "purchase"
FAMILY = {"main": "Brand#2", "second": "Brand#13", "third": "Brand#19"}
COLLECTION = FAMILY["main"]

#: Rows that one task makes of a small table.
MADE = 1_000_000


def addr(column):
    i = F.col(column) if isinstance(column, str) else column
    text = F.concat(F.lit("0x"), F.lpad(i.cast("string"), 40, "0"))
    return F.when(i == 0, ZERO_ADDRESS).when(i == 1, DEAD_ADDRESS).otherwise(text)


ACCOUNT = "0x" + "7".rjust(40, "0")


def spread(df, rows):
    """``df``, each row of which becomes ``rows`` more, in tasks of about a million of those; a small file is one task otherwise."""
    return df.repartition(1 + df.count() * rows // MADE)


# Column types of the driver's files.
DRIVER_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


class Ledgers:
    """Lazily shaped tables over one scale-factor folder."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root

    def read(self, name):
        return self.spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{self.root}/{name}.parquet")

    # --- event ledger --------------------------------------------------------------------

    def events(self):
        e = self.read("events")
        ids = self.read("events").agg((F.max("user_id") + 1).alias("n")).scalar()
        receiver = F.pmod(F.col("user_id") * 31 + F.col("event_id") * 17 + 5, ids)
        return (e.withColumn("cents", F.round(F.col("value") * 100).cast("decimal(38,0)"))
                .withColumn("sender", F.col("user_id")).withColumn("receiver", receiver)
                .withColumn("hash", F.col("event_id").cast("string")))

    def erc20_events(self):
        return self.events().select(
            F.col("ts").alias("evt_block_time"), F.col("hash").alias("evt_tx_hash"),
            addr("sender").alias("from"), addr("receiver").alias("to"),
            F.col("event_type").alias("contract_address"), F.col("cents").alias("value"))

    def erc20_events_funded(self):
        spent = self.erc20_events().filter(F.col("from") != DEAD_ADDRESS)
        mints = self.read("events").select("user_id").distinct()
        types = F.array(*[F.lit(t) for t in ("view", "signup", "purchase", "error", "click")])
        minted = (mints.filter("user_id >= 2")
                  .select("user_id", F.explode(types).alias("contract_address"))
                  .select(F.lit("2023-12-31").cast("timestamp_ntz").alias("evt_block_time"),
                          F.concat(F.lit("mint-"), "contract_address", F.lit("-"),
                                   F.col("user_id").cast("string")).alias("evt_tx_hash"),
                          F.lit(ZERO_ADDRESS).alias("from"), addr("user_id").alias("to"),
                          "contract_address", F.lit(200000).cast("decimal(38,0)").alias("value")))
        return spent.unionByName(minted)

    def tokens_events(self):
        return (self.read("events").select("event_type").distinct().filter("event_type <> 'error'")
                .select(F.col("event_type").alias("contract_address"),
                        F.upper("event_type").alias("symbol"), F.lit(2).alias("decimals"),
                        F.lit("ethereum").alias("blockchain")))

    def prices_events(self):
        return self.read("events").filter("event_type <> 'signup'").select(
            F.col("ts").alias("minute"), F.lit("ethereum").alias("blockchain"),
            F.col("event_type").alias("contract_address"), F.upper("event_type").alias("symbol"),
            F.col("value").alias("price"))

    def traces(self):
        kind = (F.when(F.col("event_type") == "error", "delegatecall")
                .when(F.col("event_type") == "view", F.lit(None)).otherwise("call"))
        return self.events().select(
            F.col("ts").alias("block_time"), F.col("hash").alias("tx_hash"),
            addr("sender").alias("from"), addr("receiver").alias("to"),
            (F.col("cents").cast("decimal(18,0)") * F.lit(10 ** 16).cast("decimal(17,0)"))
            .cast("decimal(38,0)").alias("value"),
            F.col("props").cast("binary").alias("input"),
            F.when(F.col("event_type") == "signup", "create").otherwise("call").alias("type"),
            kind.alias("call_type"), (F.col("event_id") % 10 != 0).alias("success"))

    def gas_fees(self):
        return self.events().select(
            F.col("hash").alias("tx_hash"), F.lit("ethereum").alias("blockchain"),
            addr("sender").alias("tx_sender"), F.col("value").alias("gas_price_gwei"),
            (F.lit(21000) + F.col("event_id") % 1000).alias("gas_used"), F.col("ts").alias("block_time"))

    def erc1155_single(self):
        return self.erc20_events().withColumn("id", F.col("evt_tx_hash"))

    # --- order ledger --------------------------------------------------------------------

    def order_lines(self):
        slots = self.read("supplier").agg((F.max("s_suppkey") + 1).alias("n")).scalar()
        # Parts first: most reports ask for one brand, which leaves few lines to join further.
        return (self.read("lineitem")
                .join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
                .join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                .withColumn("receiver", F.pmod("o_custkey", slots))
                .withColumn("hash", F.col("o_orderkey").cast("string")))

    def items(self):
        return self.order_lines().select(
            F.col("l_shipdate").alias("evt_block_time"), F.col("hash").alias("evt_tx_hash"),
            addr("l_suppkey").alias("from"), addr("receiver").alias("to"),
            F.col("p_brand").alias("contract_address"),
            F.col("l_partkey").cast("string").alias("tokenId"))

    def items_funded(self):
        spent = self.items().filter(F.col("from") != DEAD_ADDRESS)
        brand = F.explode(F.sequence(F.lit(1), F.lit(25))).alias("b")
        owners = self.read("supplier").filter("s_suppkey >= 2").select("s_suppkey")
        minted = (spread(owners, 25 * 30).select("s_suppkey", brand)
                  .select("s_suppkey", "b", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("k"))
                  .select(F.lit("1995-01-01").cast("timestamp_ntz").alias("evt_block_time"),
                          F.concat_ws("-", F.lit("mint"), "b", "s_suppkey", "k").alias("evt_tx_hash"),
                          F.lit(ZERO_ADDRESS).alias("from"), addr("s_suppkey").alias("to"),
                          F.concat(F.lit("Brand#"), F.col("b").cast("string")).alias("contract_address"),
                          (F.col("s_suppkey") * 100 + F.col("k") + 1000000).cast("string")
                          .alias("tokenId")))
        return spent.unionByName(minted)

    def erc20_orders(self):
        return self.order_lines().select(
            F.col("l_shipdate").alias("evt_block_time"), F.col("hash").alias("evt_tx_hash"),
            addr("l_suppkey").alias("from"), addr("receiver").alias("to"),
            F.col("p_brand").alias("contract_address"),
            F.col("l_quantity").cast("decimal(38,0)").alias("value"))

    def tokens_orders(self):
        return self.read("part").select("p_brand").distinct().select(
            F.col("p_brand").alias("contract_address"), F.upper("p_brand").alias("symbol"),
            F.lit(0).alias("decimals"), F.lit("ethereum").alias("blockchain"))

    def tokens_nft(self):
        return (self.read("part").filter("p_brand <> 'Brand#7'").groupBy("p_brand")
                .agg(F.min("p_name").alias("name"))
                .select(F.col("p_brand").alias("contract_address"), "name",
                        F.lit("ethereum").alias("blockchain")))

    def dex_trades(self):
        even = F.col("l_linenumber") % 2 == 0
        bought = F.when(even, F.col("p_brand")).otherwise(F.col("p_type"))
        sold = F.when(even, F.col("p_type")).otherwise(F.col("p_brand"))
        return self.order_lines().select(
            F.to_date("o_orderdate").alias("block_date"), F.lit("ethereum").alias("blockchain"),
            F.col("o_orderpriority").alias("project"), F.col("hash").alias("tx_hash"),
            addr("o_custkey").alias("tx_from"), bought.alias("token_bought_address"),
            sold.alias("token_sold_address"), F.lower(bought).alias("token_bought_symbol"),
            F.lower(sold).alias("token_sold_symbol"), F.col("l_quantity").alias("token_bought_amount"),
            F.col("l_quantity").alias("token_sold_amount"), F.col("l_extendedprice").alias("amount_usd"))

    def nft_trades(self):
        price = F.col("l_extendedprice")
        return self.order_lines().select(
            F.to_date("l_shipdate").alias("block_date"), F.col("l_shipdate").alias("block_time"),
            F.lit("ethereum").alias("blockchain"), F.col("p_brand").alias("nft_contract_address"),
            F.col("l_partkey").cast("string").alias("token_id"), F.col("hash").alias("tx_hash"),
            addr("l_suppkey").alias("tx_from"), addr("receiver").alias("tx_to"),
            price.alias("amount_usd"), (price * F.col("l_tax")).alias("platform_fee_amount_usd"),
            (price * F.col("l_discount")).alias("royalty_fee_amount_usd"))

    def erc1155_batch(self):
        line = F.struct("l_linenumber", "l_partkey", "l_quantity")
        lines = self.order_lines().groupBy("hash", "o_orderdate", "o_orderpriority", "receiver").agg(
            F.sort_array(F.collect_list(line)).alias("lines"))
        field = lambda name, kind: F.transform("lines", lambda x: x[name].cast(kind))
        return lines.select(
            F.col("o_orderdate").alias("evt_block_time"), F.col("hash").alias("evt_tx_hash"),
            addr("receiver").alias("from"),
            addr(F.pmod(F.col("hash").cast("bigint"), F.lit(10))).alias("to"),
            F.col("o_orderpriority").alias("contract_address"),
            field("l_partkey", "string").alias("ids"), field("l_quantity", "decimal(38,0)").alias("values"))

    def contracts(self):
        def entries(df, column, label):
            return df.select(F.col(column).alias("address"), F.lower(column).alias("name"),
                             F.lit(label).alias("namespace"), F.lit(ACCOUNT).alias("from"))

        return (entries(self.read("events").select("event_type").distinct(), "event_type", "event")
                .unionByName(entries(self.read("part").select("p_brand").distinct(), "p_brand", "part"))
                .unionByName(entries(self.read("orders").select("o_orderpriority").distinct(),
                                     "o_orderpriority", "order"))
                .unionByName(entries(self.read("nation"), "n_name", "nation")))

    # --- source sets ---------------------------------------------------------------------

    def event_sources(self, funded=False):
        return Sources({
            "erc20_transfers": self.erc20_events_funded if funded else self.erc20_events,
            "erc721_transfers": self.items_funded if funded else self.items,
            "erc1155_single": self.erc1155_single, "erc1155_batch": self.erc1155_batch,
            "traces": self.traces, "gas_fees": self.gas_fees, "prices_usd": self.prices_events,
            "tokens_erc20": self.tokens_events, "tokens_nft": self.tokens_nft,
            "contracts": self.contracts,
        }, EVENT_DAY)

    def order_sources(self, funded=False):
        return Sources({
            "erc20_transfers": self.erc20_orders, "tokens_erc20": self.tokens_orders,
            "erc721_transfers": self.items_funded if funded else self.items,
            "dex_trades": self.dex_trades, "nft_trades": self.nft_trades,
            "tokens_nft": self.tokens_nft,
        }, ORDER_DAY)
