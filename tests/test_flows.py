import pytest
from pyspark.sql import functions as F

from chaintally.functions.columns import explorer_link, hex_address, ratio, scaled
from chaintally.operators import flows
from chaintally.schemas import SOURCES, require_columns
from chaintally.functions import wide
from chaintally.sources.catalog import Sources, normalise, write_layer
from verification import ledgers
from conftest import A, B, C, D, TINY, TRANSFER, at, day, sources, table


def test_scale_amount_keeps_unknown_tokens_as_null(spark):
    df = table(spark, [("tok", 12345), ("nope", 7), ("oth", None)],
               "contract_address string, value raw")
    meta = spark.createDataFrame([("tok", "T", 2), ("oth", "O", 1)],
                                 "token_ca string, token_symbol string, decimals int")
    assert day(flows.scale_amount(df, meta), "contract_address", "value_token") == [
        ("nope", None), ("oth", None), ("tok", 123.45)]


def test_token_info_is_one_row_per_contract_and_chain(spark):
    meta = spark.createDataFrame(
        [("x", "B", 2, "ethereum"), ("x", "A", 3, "ethereum"), ("x", None, 1, "ethereum"),
         ("y", "Y", 0, "other")],
        "contract_address string, symbol string, decimals int, blockchain string")
    assert day(flows.token_info(meta, "ethereum"), "token_ca", "token_symbol", "decimals") == [("x", "A", 3)]


def test_account_transfers_test_the_sender_first(spark, tiny):
    rows = flows.account_transfers(tiny.table("erc20_transfers"), A, tx_col="evt_tx_hash")
    assert day(rows, "evt_tx_hash", "transfer_type", "counter_address") == [
        ("t1", "to", "0x0000000000000000000000000000000000000000"), ("t2", "from", B), ("t4", "to", B),
        ("t5", "from", A)]


def test_account_transfers_need_both_parties_and_a_hash(spark):
    rows = table(
        spark, [(at(D[1]), None, A, B, "tok", 1), (at(D[1]), "h", None, A, "tok", 1),
         (at(D[1]), "k", A, None, "tok", 1)], TRANSFER)
    assert flows.account_transfers(rows, A, tx_col="evt_tx_hash").count() == 0
    assert day(flows.account_transfers(rows, A), "transfer_type", "counter_address") == [
        ("from", None), ("from", B), ("to", None)]


def test_explode_batch_pairs_by_position_or_crosses(spark):
    df = spark.createDataFrame([("e", [1, 2], [10, 20])], "tx string, ids array<int>, values array<int>")
    assert day(flows.explode_batch(df), "tx", "id", "value") == [("e", 1, 10), ("e", 2, 20)]
    assert len(day(flows.explode_batch(df, pairing="cross"), "tx", "id", "value")) == 4


def test_cross_pairs_of_one_batch_are_unfolded_without_comparing_them(spark):
    df = spark.createDataFrame([(f"e{i}", [1, 2, 2, None], [10, 10, 20]) for i in range(20)] * 2, "tx string, ids array<long>, values array<long>")
    pairs = flows.explode_batch(df, pairing="cross")
    assert len(day(pairs, "tx", "id", "value")) == pairs.distinct().count() == 20 * 3 * 2
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_cross_pairs_of_events_in_several_batches_are_distinct(spark, monkeypatch):
    monkeypatch.setattr(flows, "PAIRS", 3)
    rows = [("a", [1, 2], [10, 20]), ("a", [2, 3], [10]), ("b", [1], [5]), ("b", [1], [5]), (None, [7], [1]), (None, [7, None], [1, None]),
            ("c", None, [1]), ("c", [], [1]), ("d", [1], None), ("e", [4, 4], [9, 9])]
    want = {(tx, i, v) for tx, ids, values in rows for i in ids or [] for v in values or []}
    df = spark.createDataFrame(rows, "tx string, ids array<long>, values array<long>")
    found = [tuple(r) for r in flows.explode_batch(df, pairing="cross").collect()]
    assert len(found) == len(want) and set(found) == want
    bare = [tuple(r) for r in flows.explode_batch(df.drop("tx"), pairing="cross").collect()]
    assert len(bare) == len(set(bare)) and set(bare) == {w[1:] for w in want}
    assert flows.explode_batch(df.limit(0), pairing="cross").count() == 0


def test_value_calls(spark):
    rows = [("call", None, True, 5), ("call", "call", True, 0), ("call", "delegatecall", True, 5),
            ("call", "staticcall", True, 5), ("call", "callcode", True, 5), ("create", None, True, 5),
            ("call", None, False, 5), ("call", "call", True, 7)]
    df = table(spark, rows, "type string, call_type string, success boolean, value raw")
    assert day(flows.value_calls(df), "value") == [(5,), (7,)]
    assert day(flows.value_calls(df, False), "value") == [(0,), (5,), (7,)]


def test_gas_cost_is_exact_in_wei(spark):
    df = spark.createDataFrame([(12.345678901, 21000)], "gas_price_gwei double, gas_used long")
    row = flows.gas_cost(df).first()
    assert int(row.gas_wei) == 12345678901 * 21000
    assert row.gas_eth == pytest.approx(12.345678901 * 21000 / 1e9)


def ledger(src):
    return src.table("erc20_transfers").select(
        F.to_date("evt_block_time").alias("date"), F.col("from").alias("from_address"),
        F.col("to").alias("to_address"), "value")


def test_signed_flows_and_net_flows(tiny):
    legs = flows.signed_flows(ledger(tiny), "value", label=True)
    assert [r for r in day(legs, "date", "address", "transfer_type", "transfer_amount") if r[1] == A] == [
        (D[1], A, "buy", 100), (D[3], A, "sell", -40), (D[5], A, "buy", 35), (D[5], A, "sell", -5)]
    net = flows.net_flows(flows.signed_flows(ledger(tiny), "value", pre_aggregate=False))
    assert [r for r in day(net, "date", "address", "net_amount") if r[1] == B] == [(D[3], B, 30), (D[5], B, -30)]
    assert net.agg(F.sum("net_amount")).first()[0] == 0


def test_in_out_by_date(tiny):
    rows = flows.account_transfers(tiny.table("erc20_transfers"), A).withColumn(
        "date", F.to_date("evt_block_time")).withColumn("fee", F.lit(1))
    out = flows.in_out_by_date(rows, ["value"], out_only=["fee"])
    assert day(out, "date", "value_in", "value_out", "fee", "value_net") == [
        (D[1], 100, None, None, 100), (D[3], None, 40, 1, -41), (D[5], 30, 5, 1, 24)]


def test_exclude_and_restrict(spark, tiny):
    kept = flows.exclude_addresses(tiny.table("erc20_transfers"), "to")
    assert {r["to"] for r in kept.collect()} == {A, B}
    who = spark.createDataFrame([(A,)], "address string")
    assert flows.restrict_to(tiny.table("erc20_transfers"), "from", who).count() == 2


def test_orient_trades_gives_the_other_side_as_counter(spark):
    cols = ("block_date date, project string, tx_hash string, tx_from string, token_bought_address string, "
            "token_sold_address string, token_bought_symbol string, token_sold_symbol string, "
            "token_bought_amount double, token_sold_amount double, amount_usd double")
    df = spark.createDataFrame([
        (D[1], "p", "h1", A, "tok", "oth", "TOK", "OTH", 1.0, 2.0, 3.0),
        (D[1], "p", "h2", A, "oth", "tok", "OTH", "TOK", 4.0, 5.0, 6.0),
        (D[1], "p", "h3", A, "oth", "oth", "OTH", "OTH", 4.0, 5.0, 6.0),
        (D[1], "p", None, A, "tok", "oth", "TOK", "OTH", 1.0, 2.0, 3.0),
        (D[1], "p", "h5", A, None, "tok", None, "TOK", 1.0, 2.0, 3.0)], cols)
    assert day(flows.orient_trades(df, "tok"), "tx_hash", "trade_type", "token_symbol", "amount_token",
               "counter_token_ca", "counter_token_symbol") == [
        ("h1", "buy", "TOK", 1.0, "oth", "OTH"), ("h2", "sell", "TOK", 5.0, "oth", "OTH")]


def test_columns(spark):
    df = spark.createDataFrame([(bytearray(b"\xAB\x01"), "0xAb", 0)], "b binary, s string, z int")
    row = df.select(hex_address(F.col("b")).alias("h"), ratio(F.lit(1), "z").alias("q"),
                    scaled(F.lit(250), 2).alias("u"),
                    explorer_link("s", "http://x/", "go").alias("l")).first()
    assert (row.h, row.q, row.u) == ("0xab01", None, 2.5)
    assert row.l == '<a href="http://x/0xAb" target="_blank">go</a>'


def test_sources_check_columns_filter_chain_and_day(spark):
    src = sources(spark, TINY, as_of=D[3])
    assert src.table("erc20_transfers").count() == 3
    assert src.table("tokens_erc20").count() == 2
    src.register_views(spark, ["tokens_erc20"])
    assert spark.sql("SELECT * FROM tokens_erc20 WHERE decimals = :d", args={"d": 1}).count() == 1
    with pytest.raises(ValueError, match="lacks columns"):
        require_columns(spark.range(1), SOURCES["contracts"], "contracts")


def test_parquet_round_trip_with_wide_text_amounts(spark, tmp_path):
    rows = [(at(D[1]), bytearray(b"\x0F"), "0xAA", "0xBB", "0xCC", "123456789012345678901234567890")]
    spark.createDataFrame(rows, "evt_block_time timestamp_ntz, evt_tx_hash binary, `from` string, `to` string, "
                          "contract_address string, value string").write.parquet(str(tmp_path / "erc20_transfers"))
    src = Sources.from_parquet(spark, str(tmp_path), D[6], normalised=False)
    row = src.table("erc20_transfers").first()
    assert (row.evt_tx_hash, row["from"], int(row.value)) == ("0x0f", "0xaa", 123456789012345678901234567890)
    assert normalise(src.table("erc20_transfers"), "erc20_transfers").first()["to"] == "0xbb"


def test_write_layer_partitions_by_day(spark, tmp_path):
    df = spark.createDataFrame([(D[1], A, 1), (D[2], B, 2)], "date date, address string, v int")
    back = write_layer(df, str(tmp_path / "layer"), cluster_by="address")
    assert sorted(p.name for p in (tmp_path / "layer").glob("date=*")) == [
        "date=2024-01-01", "date=2024-01-02"]
    assert day(back, "date", "address", "v") == [(D[1], A, 1), (D[2], B, 2)]


@pytest.mark.parametrize("limit", [0, 10])
def test_join_strategies_agree_on_either_side_of_the_size_check(spark, tiny, limit):
    rows = tiny.table("erc20_transfers")
    who = spark.createDataFrame([(A,), (A,)], "address string")
    kept = flows.restrict_to(rows, "from", who, max_rows=limit)
    assert day(kept, "evt_tx_hash") == [("t2",), ("t5",)]
    legs = flows.signed_flows(ledger(tiny), "value", pre_aggregate=False)
    near = flows.narrow_to(legs, "address", who.distinct(), max_rows=limit)
    totals = near.groupBy("address").agg(F.sum("transfer_amount").alias("n"))
    assert day(who.distinct().join(totals, "address"), "address", "n") == [(A, 90)]
    meta = flows.token_info(tiny.table("tokens_erc20"))
    assert flows.scale_amount(rows, meta, max_rows=limit).filter("value_token IS NULL").count() == 0


def test_layers_answer_sql(spark, tiny):
    from chaintally.plans.views import register_layers
    register_layers(tiny, "tok", prefix="tiny_")
    assert spark.sql("SELECT sum(balance_token) AS s FROM tiny_holders").first().s == 90.0
    assert spark.sql("SELECT count(*) AS n FROM tiny_transfers").first().n == 5


def test_amounts_of_any_width_are_exact(spark, tmp_path):
    from chaintally.plans import account, token
    huge, odd = 2 ** 255, 2 ** 255 // 7
    rows = [(at(D[1]), "h1", A, B, "tok", "70"), (at(D[1]), "h2", A, B, "oth", str(huge))]
    for i in range(40):  # what comes in goes out again, in other pieces
        who = f"0x{i + 100}"
        rows += [(at(D[1]), f"m{i}", A, who, "tok", "5"), (at(D[1]), f"i{i}", A, who, "oth", str(odd + i)),
                 (at(D[2]), f"j{i}", A, who, "oth", str(odd * 2)), (at(D[3]), f"o{i}", who, C, "oth", str(odd * 3 + i))]
    spark.createDataFrame(rows, TRANSFER.replace("value raw", "value string")).write.parquet(
        str(tmp_path / "erc20_transfers"))
    for name, df in (("tokens_erc20", sources(spark, []).tables["tokens_erc20"]),
                     ("prices_usd", sources(spark, []).tables["prices_usd"])):
        df.write.parquet(str(tmp_path / name))
    src = Sources.from_parquet(spark, str(tmp_path), D[6])
    assert token.holders(src, "tok").count() == 41
    owned = token.overlap_erc20(src, "tok").filter("contract_address = 'oth'")
    assert day(owned, "address", "balance_token") == [(B, float(huge) / 10)]
    before = Sources.from_parquet(spark, str(tmp_path), D[2])
    assert token.overlap_erc20(before, "tok").filter("contract_address = 'oth'").count() == 41
    daily = account.account_balance_erc20(src, B).filter("contract_address = 'oth'")
    assert {r.balance_token for r in daily.collect()} == {float(huge) / 10}
    spent = account.account_balance_erc20(src, "0x103").filter("contract_address = 'oth'")
    assert day(spent, "date", "balance_token")[-1] == (D[6], 0.0)


def test_wide_sums_have_the_right_sign(spark):
    values = [0, 1, 10 ** 26 - 1, 10 ** 26, 10 ** 52, 2 ** 256 - 1, 10 ** 40 + 7]
    pairs = [(str(a), str(b)) for a in values for b in values]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = wide.limbs("a"), wide.limbs("b")
    less = [a[n] - b[n] for n in wide.LIMBS]
    got = df.select("a", "b", wide.is_positive(*less).alias("more"), wide.as_units(*less, 0).alias("units")).collect()
    for r in got:
        exact = int(r.a) - int(r.b)
        assert r.more == (exact > 0) and r.units == pytest.approx(float(exact), rel=1e-15)


def test_item_ids_of_any_width(spark):
    from chaintally.plans import account
    big = str(2 ** 255)
    moves = spark.createDataFrame([(at(D[1]), "h", A, B, "col", big)],
                                  TRANSFER.replace("value raw", "tokenId string"))
    src = Sources({"erc721_transfers": moves}, D[6])
    assert day(account.account_transfers_erc721(src, B), "tokenId") == [(big,)]


def test_types_and_time_zone_are_checked_at_the_boundary(spark):
    rows = [(at(D[1]), "h1", A, B, "tok", 7)]
    wrong = spark.createDataFrame([("2024-01-01", *rows[0][1:])], TRANSFER.replace("timestamp_ntz", "string").replace("raw", "long"))
    with pytest.raises(ValueError, match="wrong type"):
        Sources({"erc20_transfers": wrong}, D[6]).table("erc20_transfers")
    zoned = spark.createDataFrame(rows, TRANSFER.replace("timestamp_ntz", "timestamp").replace("raw", "long"))
    assert Sources({"erc20_transfers": zoned}, D[6]).table("erc20_transfers").count() == 1
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        with pytest.raises(ValueError, match="time zone"):
            Sources({"erc20_transfers": zoned}, D[6]).table("erc20_transfers")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("timed", [True, False])
def test_fees_after_the_day_looked_at_are_not_charged(spark, timed):
    from chaintally.plans.token import native_totals
    traces = spark.createDataFrame(
        [(at(D[1]), "t1", B, A, 5, b"", "call", "call", True), (at(D[9]), "t2", A, B, 0, b"", "call", "call", True)],
        "block_time timestamp_ntz, tx_hash string, `from` string, `to` string, value long, input binary, type string, call_type string, success boolean")
    gas = spark.createDataFrame([("t1", "ethereum", B, 1.0, 1, at(D[1])), ("t2", "ethereum", A, 1.0, 1, at(D[9]))],
                                "tx_hash string, blockchain string, tx_sender string, gas_price_gwei double, gas_used long, block_time timestamp_ntz")
    tables = {"traces": traces, "gas_fees": gas if timed else gas.drop("block_time")}
    got = {r.address: r.wei_gas for r in native_totals(Sources(tables, D[3])).collect()}
    assert got == {A: None, B: 10 ** 9}
    assert {r.address: r.wei_gas for r in native_totals(Sources(tables, D[9])).collect()} == {A: 10 ** 9, B: 10 ** 9}


def test_layer_has_about_as_many_files_as_days_and_takes_single_days(spark, tmp_path):
    days = [D[1 + i % 30] for i in range(3000)]
    df = spark.createDataFrame([(d, f"0x{i % 97}", i) for i, d in enumerate(days)], "date date, address string, v int").repartition(8)
    for path, cluster in ((tmp_path / "plain", None), (tmp_path / "sorted", "address")):
        assert write_layer(df, str(path), cluster_by=cluster).count() == 3000
        assert len(list(path.glob("date=*/*.parquet"))) <= 30 + 8
    one = spark.createDataFrame([(D[1], "0xnew", -1)], "date date, address string, v int")
    back = write_layer(one, str(tmp_path / "plain"))
    assert back.filter(F.col("date") == D[1]).count() == 1 and back.count() == 2901


def test_a_fee_is_charged_once(spark):
    rows = spark.createDataFrame([(D[1], "from", 10, 4, 1), (D[1], "to", 7, 3, 1)], "date date, transfer_type string, a int, b int, fee int")
    got = flows.in_out_by_date(rows, ["a", "b"], out_only=["fee"])
    assert day(got, "a_net", "b_net") == [(-4, -1)]


def test_items_made_of_a_small_table_are_made_in_several_tasks(spark, tmp_path, monkeypatch):
    for name, ddl in ledgers.DRIVER_SCHEMAS.items():
        n = 40 if name == "supplier" else 0
        nulls = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ddl.split(", ")]
        rows = spark.range(n).select("id", *nulls)
        rows = rows.withColumn("s_suppkey", F.col("id")) if n else rows
        rows.drop("id").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(ledgers, "MADE", 5_000)
    made = ledgers.Ledgers(spark, str(tmp_path)).items_funded()
    tasks = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 38 * 25 * 30 and len(tasks) > 3 and max(tasks) <= 7_500
    assert made.distinct().count() == sum(tasks)
