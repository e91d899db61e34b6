"""Facts that must hold whatever the data, checked on the driver's tables."""

import pytest
from pyspark.sql import functions as F

from chaintally.operators import balances, flows, spines
from chaintally.plans import account, collection, token
from conftest import TESTDATA, day
from verification.ledgers import ACCOUNT, COLLECTION, TOKEN, Ledgers

ROOT = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return Ledgers(spark, ROOT).event_sources()


@pytest.fixture(scope="module")
def funded(spark):
    return Ledgers(spark, ROOT).event_sources(True)


@pytest.fixture(scope="module")
def orders(spark):
    return Ledgers(spark, ROOT).order_sources(True)


def test_balances_of_a_day_sum_to_zero(raw):
    sums = token.balance(raw, TOKEN).groupBy("date").agg(F.round(F.sum("balance_token"), 6).alias("s"))
    assert {r.s for r in sums.collect()} == {0.0}


def test_supply_is_mint_plus_burn_with_their_signs(funded):
    for r in token.supply_mint_burn(funded, TOKEN).collect():
        assert r.total_supply == pytest.approx(r.total_mint + r.total_burn)


def test_windows_nest_and_cumulative_users_never_fall(raw):
    rows = token.active_addresses(raw, TOKEN).collect()
    assert all(r.dau_to <= r.wau_to <= r.mau_to and r.dau_from <= r.wau_from <= r.mau_from for r in rows)
    users = [r.cumulative_dau for r in account.contract_cumulative_users(raw, ACCOUNT).collect()]
    assert users == sorted(users)


def test_top_labels_add_up_to_the_supply(funded):
    tops = token.wealth_gap_balance(funded, TOKEN).groupBy("date").agg(F.sum("balance_token").alias("s"))
    both = tops.join(token.supply_mint_burn(funded, TOKEN), "date")
    assert both.count() == 32
    assert both.filter(F.abs(F.col("s") - F.col("total_supply")) > 1e-6).count() == 0


def test_shares_of_all_holders_sum_to_one(funded):
    total = token.top_holders_list(funded, TOKEN, n=10 ** 6).agg(F.sum("share")).first()[0]
    assert total == pytest.approx(1.0)


def test_holdings_shares_end_at_one(orders):
    last = collection.holding_distribution(orders, COLLECTION).orderBy(F.desc("nfts_cnt")).first()
    assert last.cum_nfts_share == 1.0 and last.cum_address_share == 1.0


def test_concentration_bounds_and_holder_flow(orders):
    counts = {r.date: r for r in collection.holders_main(orders, COLLECTION).collect()}
    for r in collection.hhi_daily(orders, COLLECTION).collect():
        assert 1 / counts[r.date].holders_cnt - 1e-12 <= r.hhi <= 1 + 1e-12
    moves = collection.holders_in_out(orders, COLLECTION).collect()
    assert len(moves) == len(counts)
    for r in sorted(moves)[1:]:
        assert r.holders_in_cnt + r.holders_out_cnt == counts[r.date].holders_dod


def test_delta_forms_equal_the_grid(orders):
    grid = collection.daily_balance(orders, COLLECTION)
    by_day = grid.groupBy("date").agg(F.count(F.when(F.col("balance") > 0, 1)).alias("n"))
    fast = collection.holders_main(orders, COLLECTION)
    assert day(by_day, "date", "n") == day(fast, "date", "holders_cnt")


def test_layers_can_be_stored_and_read_back(spark, raw, tmp_path):
    from chaintally.sources.catalog import write_layer
    stored = write_layer(token.transfers(raw, TOKEN), str(tmp_path / "transfers"), cluster_by="from_address")
    assert stored.count() == token.transfers(raw, TOKEN).count()


def test_plans_hold_no_cross_join_and_no_python(spark, raw, orders):
    reports = [token.balance, token.wealth_gap_balance, token.top_holders_list, token.overlap_erc20,
               token.active_addresses, token.volume, token.marketcap, token.avg_purchase_price]
    frames = [r(raw, TOKEN) for r in reports] + [
        r(orders, COLLECTION) for r in (collection.hhi_daily, collection.holding_distribution,
                                        collection.nft_price_volume, collection.nft_token_stats,
                                        token.dex_dominance_daily)]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "BatchEvalPython"):
            assert bad not in plan, (df.columns, bad)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    """Over stored ledgers the token filter is pushed down and only used columns are read."""
    src = Ledgers(spark, ROOT).event_sources()
    path = str(tmp_path / "erc20")
    src.table("erc20_transfers").write.parquet(path)
    src.tables["erc20_transfers"] = spark.read.parquet(path)
    src._seen.clear()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = token.holders(src, TOKEN)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "value" in line)
    assert "contract_address" in scan and "EqualTo(contract_address,click)" in plan
    rolling = token.active_addresses(src, TOKEN)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(contract_address,click)" in rolling and "value:decimal" not in rolling


def test_net_flows_bound_rows_per_address_by_days(raw):
    rows = raw.table("erc20_transfers").select(
        F.to_date("evt_block_time").alias("date"), F.col("from").alias("from_address"),
        F.col("to").alias("to_address"), "value")
    net = flows.net_flows(flows.signed_flows(rows, "value", pre_aggregate=False))
    most = net.groupBy("address").count().agg(F.max("count")).first()[0]
    assert most <= spines.date_spine(rows, "date", raw.today).count()
    assert balances.current_totals(flows.signed_flows(rows, "value")).agg(F.sum("balance")).first()[0] == 0
