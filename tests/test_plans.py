"""Plans: what is cut before it is read on, and what is not shuffled."""

import pytest
from pyspark.sql import functions as F

from chaintally.operators import flows, prices, ranking
from chaintally.plans import account, token
from conftest import TESTDATA
from verification.ledgers import ACCOUNT, TOKEN, Ledgers


@pytest.fixture()
def src(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Ledgers(spark, f"{TESTDATA}/sf0.001").event_sources()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_account_reports_read_only_their_own_fees_and_ticks(src, monkeypatch):
    monkeypatch.setattr(prices, "materialise", lambda df: df)  # keep the whole plan in sight
    assert "LeftSemi" in optimized(account.account_transfers_eth(src, ACCOUNT))
    assert "LeftSemi" in optimized(account.account_balance_erc20(src, ACCOUNT))


def test_prices_and_day_totals_are_broadcast_once_counted(spark, src):
    rows = src.table("erc20_transfers").selectExpr("to_date(evt_block_time) AS date", "contract_address", "`to` AS address", "1.0D AS balance_token")
    valued = prices.attach_usd(rows, prices.daily_close(src.table("prices_usd")), on=("date", "contract_address"))
    shared = ranking.share_of_total(rows, "balance_token", part="date")
    for df in (valued, shared):
        assert "BroadcastHashJoin" in physical(df) and "SortMergeJoin" not in physical(df)


def test_contracts_meet_holdings_without_a_shuffle_by_contract(src):
    plan = physical(token.overlap_erc20(src, TOKEN))
    assert "BroadcastHashJoin [contract_address" in plan


def test_a_large_holder_set_thins_rows_before_they_are_aggregated(spark, src, tmp_path):
    """Above the limit, what is aggregated are the holders' rows and the filter's errors, and the broadcast is bounded."""
    events = spark.range(200_000).selectExpr("concat('0x', id % 20000) AS address", "1L AS n")
    holders = spark.range(2000).selectExpr("concat('0x', id * 10) AS address")
    assert flows.narrow_to(events, "address", holders, max_rows=10_000).count() == 20_000
    kept = flows.narrow_to(events, "address", holders, max_rows=0)
    assert 20_000 <= kept.count() <= 20_000 + 0.15 * 180_000
    assert kept.join(holders, "address", "left_anti").count() == kept.count() - 20_000
    plan = physical(kept.groupBy("address").agg(F.sum("n")))
    assert plan.index("BroadcastHashJoin") > plan.index("HashAggregate") and "SortMergeJoin" not in plan
    masks, bits = flows.address_filter(holders, "address", 2000, most=1 << 12)
    assert bits == 1 << 12 and masks.count() <= bits // 64


def test_overlap_beyond_the_limit_filters_in_the_scan(src):
    src.broadcast_rows = 0
    plan = physical(token.overlap_erc20(src, TOKEN))
    legs = plan[plan.index("Generate inline"):] if "Generate inline" in plan else plan
    assert "_spot" in plan and "_mask" in plan and legs
