import pytest
from pyspark.sql import functions as F

from chaintally.constants import DEAD_ADDRESS
from chaintally.operators import balances, flows, ranking, spines, stats
from chaintally.plans import token
from conftest import A, B, C, D, TINY, at, day, sources
from test_flows import ledger


def net_of(src):
    return flows.net_flows(flows.signed_flows(ledger(src), "value", pre_aggregate=False))


def today(d):
    return F.lit(d).cast("date")


def test_spines_and_frame(tiny):
    rows = ledger(tiny)
    assert day(spines.date_spine(rows, "date", tiny.today), "date") == [(D[i],) for i in range(1, 7)]
    assert spines.address_spine(rows).count() == 4
    assert day(spines.key_spine(rows, ["from_address"]), "from_address")[1:] == [(A,), (B,)]
    frame = spines.dense_frame(spines.address_spine(rows), spines.first_day(rows), tiny.today)
    assert frame.count() == 4 * 6 and frame.distinct().count() == 24


def test_fill_days_carries_or_blanks(spark):
    s = spark.createDataFrame([(D[1], 5, 7), (D[4], 6, 8)], "date date, a int, b int")
    out = spines.fill_days(s, today(D[5]), carry=["a"], on_day=["b"], absent={"b": 0})
    assert day(out, "date", "a", "b") == [
        (D[1], 5, 7), (D[2], 5, 0), (D[3], 5, 0), (D[4], 6, 8), (D[5], 6, 0)]
    early = spines.fill_days(s, today(D[2]), carry=["a"])
    assert day(early, "date", "a") == [(D[1], 5), (D[2], 5)]


def test_running_balance_carry_sparse_and_unknown(tiny):
    net = net_of(tiny)
    start = spines.first_day(net)
    carried = balances.running_balance(net, start, tiny.today)
    assert [r[2] for r in day(carried, "address", "date", "balance") if r[0] == B] == [0, 0, 30, 30, 0, 0]
    assert [r[2] for r in day(carried, "address", "date", "balance") if r[0] == DEAD_ADDRESS] == [0, 0, 10, 10, 10, 10]
    sparse = balances.running_balance(net, start, tiny.today, gaps="sparse")
    assert [r[2] for r in day(sparse, "address", "date", "balance") if r[0] == B] == [None, None, 30, None, 0, None]
    late = balances.running_balance(net, start, tiny.today, before_first=None)
    assert [r[2] for r in day(late, "address", "date", "balance") if r[0] == B][:3] == [None, None, 30]
    assert {r[1] for r in day(carried.groupBy("date").agg(F.sum("balance").alias("s")), "date", "s")} == {0}


def test_active_balances_know_before_and_after(tiny):
    active = balances.active_balances(net_of(tiny))
    assert [r for r in day(active, "address", "date", "prev_balance", "balance", "next_date") if r[0] == A] == [
        (A, D[1], 0, 100, D[3]), (A, D[3], 100, 60, D[5]), (A, D[5], 60, 90, None)]


def test_spans_cover_the_calendar_once(tiny):
    net = net_of(tiny)
    spans = balances.balance_spans(net, spines.first_day(net), tiny.today)
    days = spans.select("address", "balance", F.explode(F.sequence("lo", "hi")).alias("date"))
    dense = balances.running_balance(net, spines.first_day(net), tiny.today)
    assert day(days, "address", "date", "balance") == day(dense, "address", "date", "balance")


def test_top_balances_lose_nothing(spark):
    """Brute force: for every block size and set of leaders the top equals that of the dense frame."""
    rows = [(at(D[1 + (7 * i) % 29]), f"h{i}", f"a{(i * 5) % 13}", f"a{(i * 7 + 3) % 13}", "tok", 10 + (i * i) % 40)
            for i in range(120)]
    net = net_of(sources(spark, rows, as_of=D[31]))
    start, end = spines.first_day(net), today(D[31])
    dense = ranking.top_ranks(balances.running_balance(net, start, end), "balance", n=3)
    want = day(dense.filter("balance > 0"), "date", "rank", "address", "balance")
    for block, leaders in ((1, 100), (4, 3), (64, 1)):
        near = balances.top_balances(net, start, end, 3, block=block, leaders=leaders)
        got = ranking.top_ranks(near, "balance", n=3)
        assert day(got, "date", "rank", "address", "balance") == want
    everyone = balances.running_balance(net, start, end)
    assert balances.top_balances(net, start, end, 50).count() == everyone.filter("balance > 0").count()


@pytest.mark.parametrize("n", [1, 3, 12])
def test_tops_with_zeros_and_debts_equal_the_dense_frame(spark, n):
    rows = [(at(D[1 + (7 * i) % 29]), f"h{i}", f"a{(i * 5) % 13}", f"a{(i * i) % 11}", "tok", 10 + (i * i) % 40) for i in range(60)]
    src = sources(spark, rows, as_of=D[31])
    net = net_of(src)
    dense = balances.running_balance(net, spines.first_day(net), today(D[31]))
    want = ranking.topn_with_others(dense, "balance", n=n)
    got = token.wealth_gap_balance(src, "tok", n=n)
    assert day(got, "date", "top10", "balance_token") == day(
        want.withColumn("balance_token", F.col("balance").cast("double")), "date", "top10", "balance_token")


def test_work_follows_flows_not_addresses_times_days(spark):
    late, days, n = 3000, 300, 10
    flows_ = spark.range(late).select(
        F.date_add(F.lit(D[1]), (F.col("id") % 50 + days - 50).cast("int")).alias("date"), F.col("id").cast("string").alias("address"),
        (F.col("id") % 97 + 1).cast("decimal(38,0)").alias("net_amount"))
    early = spark.range(20).select(F.lit(D[1]).alias("date"), F.concat(F.lit("e"), "id").alias("address"), F.lit(500).cast("decimal(38,0)").alias("net_amount"))
    net = flows_.unionByName(early)
    near = balances.top_balances(net, F.lit(D[1]).cast("date"), F.date_add(F.lit(D[1]), days), n)
    assert near.count() <= 2 * (late + 20 + days * n)


def test_daily_totals_null_if_never(spark):
    moves = spark.createDataFrame([(D[1], 1, None, None), (D[3], 2, 5, None)],
                                  "date date, a long, b long, c long")
    out = balances.daily_totals(moves, today(D[4]), ["a", "b", "c"], null_if_never=["b", "c"])
    assert day(out, "date", "a", "b", "c") == [
        (D[1], 1, 0, None), (D[2], 1, 0, None), (D[3], 3, 5, None), (D[4], 3, 5, None)]


def test_supply_split_matches_grid(tiny):
    net = net_of(tiny)
    grid = balances.running_balance(net, spines.first_day(net), tiny.today)
    by_grid = day(stats.supply_mint_burn(grid), "date", "total_supply", "total_mint", "total_burn")
    assert by_grid[0] == (D[1], 100, 100, 0) and by_grid[-1] == (D[6], 90, 100, -10)
    fast = token.supply_mint_burn(tiny, "tok")
    assert day(fast, "date", "total_supply", "total_mint", "total_burn") == by_grid


def test_sparse_supply_has_a_nameless_group_for_quiet_days(tiny):
    rows = day(token.supply_mint_burn(tiny, "tok", gaps="sparse"), "date", "token_ca", "total_supply")
    assert (D[3], "tok", 90.0) in rows and (D[2], None, 0.0) in rows
    assert day(token.current_holders(tiny, "tok", gaps="sparse"), "date", "holders_cnt") == [
        (D[1], 1), (D[3], 2), (D[5], 1)]
    caps = dict(day(token.marketcap(tiny, "tok", gaps="sparse"), "date", "marketcap"))
    assert caps[D[1]] == 200.0 and caps[D[2]] == 0.0 and len(caps) == 6


def test_empty_ledger_keeps_every_schema(spark):
    src = sources(spark, [(at(D[1]), "x", A, B, "other", 1)])
    for report in (token.transfers, token.balance, token.holders, token.supply_mint_burn,
                   token.active_addresses, token.current_holders, token.new_holders_daily,
                   token.top_holders_list, token.wealth_gap_txs, token.wealth_gap_balance,
                   token.volume, token.price_daily, token.avg_purchase_price):
        df = report(src, "tok")
        assert df.columns and df.count() == 0, report.__name__
    unknown = sources(spark, [(at(D[1]), "x", A, B, "nameless", 1)])
    assert token.holders(unknown, "nameless").count() == 0
    assert token.active_addresses(unknown, "nameless").count() == 0


def test_transfers_after_the_day_are_ignored(spark):
    late = [*TINY, (at(D[20]), "t9", A, C, "tok", 90)]
    assert day(token.holders(sources(spark, late), "tok"), "address", "balance_token") == [(A, 90.0)]
