import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chaintally.operators import activity, balances, flows, prices, spines
from chaintally.plans import token
from conftest import A, B, D, at, day, sources
from test_calendar_and_balances import net_of, today


def test_close_and_latest(tiny):
    ticks = tiny.table("prices_usd")
    assert day(prices.daily_close(ticks), "date", "close_price") == [(D[1], 2.0), (D[3], 4.0), (D[4], None)]
    assert day(prices.daily_close(ticks, labels=["symbol"]), "date", "close_price", "symbol")[0] == (D[1], 2.0, "TOK")
    assert prices.latest_price(ticks).first().last_price == 4.0
    assert prices.latest_price(ticks, by=(), ignore_nulls=False).first().last_price is None


def test_attach_usd_keeps_or_drops_unpriced(spark, tiny):
    close = prices.daily_close(tiny.table("prices_usd"))
    df = spark.createDataFrame([(D[1], 3.0), (D[2], 3.0)], "date date, balance_token double")
    assert day(prices.attach_usd(df, close), "date", "balance_usd") == [(D[1], 6.0), (D[2], None)]
    assert prices.attach_usd(df, close, drop_unpriced=True).count() == 1


def test_moving_average_has_one_row_more_unless_exact(spark):
    df = spark.createDataFrame([(D[i], float(i)) for i in range(1, 5)], "date date, v double")
    assert [r.m for r in prices.moving_average(df, "v", {"m": 1}).orderBy("date").collect()] == [1.0, 1.5, 2.5, 3.5]
    assert [r.m for r in prices.moving_average(df, "v", {"m": 2}, exact=True).orderBy("date").collect()] == [
        1.0, 1.5, 2.5, 3.5]


def test_forward_fill(spark):
    df = spark.createDataFrame([(D[1], None), (D[2], 5), (D[3], None)], "date date, v int")
    assert day(prices.forward_fill(df, ["v"]), "date", "v") == [(D[1], None), (D[2], 5), (D[3], 5)]


def test_rolling_window_leaves_after_its_days(spark):
    df = spark.createDataFrame([(D[1], "u"), (D[8], "u"), (D[9], None)], "date date, who string")
    out = day(activity.rolling_distinct(df, {"": "who"}, {"dau": 1, "wau": 7}, today(D[16])), "date", "dau", "wau")
    assert [r[2] for r in out] == [1] * 14 + [0, 0]
    assert [r[1] for r in out] == [1] + [0] * 6 + [1] + [0] * 8


def test_rolling_and_cumulative_distinct_equal_brute_force(spark):
    rng = random.Random(7)
    seen = [(D[rng.randint(1, 25)], f"u{rng.randint(1, 12)}", f"v{rng.randint(1, 5)}") for _ in range(90)]
    df = spark.createDataFrame(seen, "date date, a string, b string")
    rows = activity.rolling_distinct(df, {"a": "a", "b": "b"}, {"d1": 1, "d7": 7, "d30": 30}, today(D[31])).collect()
    first = min(d for d, _, _ in seen)
    assert len(rows) == (D[31] - first).days + 1
    for r in rows:
        for n, p in ((1, "d1"), (7, "d7"), (30, "d30")):
            for i, k in ((1, "a"), (2, "b")):
                want = len({s[i] for s in seen if 0 <= (r.date - s[0]).days < n})
                assert r[f"{p}_{k}"] == want
    for r in activity.cumulative_distinct(df, "a", today(D[31])).collect():
        assert r.cumulative_dau == len({s[1] for s in seen if s[0] <= r.date})
        assert r.dau == len({s[1] for s in seen if s[0] == r.date})


def test_lag_delta_signs(spark):
    df = spark.createDataFrame([(D[1], 1), (D[2], 3), (D[3], 3)], "date date, n int")
    out = activity.lag_delta(df, "n", {"dod": 1}, sign_of="dod")
    assert day(out, "date", "dod", "group") == [
        (D[1], None, "negative"), (D[2], 2, "positive"), (D[3], 0, "negative")]


def random_ledger(spark, seed, days=28, people=9, rows=70):
    rng = random.Random(seed)
    return sources(spark, [
        (at(D[rng.randint(1, days)], i % 60), f"h{i}", f"p{rng.randint(0, people)}", f"p{rng.randint(0, people)}",
         "tok", rng.randint(1, 4)) for i in range(rows)], as_of=D[31])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_active_forms_equal_dense_forms(spark, seed):
    src = random_ledger(spark, seed)
    net = net_of(src)
    grid = balances.running_balance(net, spines.first_day(net), src.today).cache()
    active = balances.active_balances(net)
    assert day(activity.transitions_from_active(active, src.today), "date", "holders_in_cnt", "holders_out_cnt") == \
        day(activity.holder_transitions(grid), "date", "holders_in_cnt", "holders_out_cnt")
    for period in ("day", "week", "month"):
        for once in (False, True):
            assert day(activity.new_holders_from_active(active, src.today, period, first_time_only=once),
                       period, "new_cnt") == \
                day(activity.new_holders(grid, period, first_time_only=once), period, "new_cnt")


def test_returning_holder_counts_again_unless_first_time_only(spark):
    src = sources(spark, [(at(D[1]), "1", B, A, "tok", 1), (at(D[3]), "2", A, B, "tok", 1),
                          (at(D[5]), "3", B, A, "tok", 1)])
    assert day(token.new_holders_daily(src, "tok"), "date", "dnu") == [(D[1], 1), (D[5], 1)]
    assert day(token.new_holders_daily(src, "tok", first_time_only=True), "date", "dnu") == [(D[1], 1)]
    assert day(token.new_holders_weekly(src, "tok"), "week", "wnu") == [(D[1], 1)]


def test_holder_entering_on_the_first_day_is_no_event(tiny):
    grid = flows.exclude_addresses(balances.running_balance(
        net_of(tiny), spines.first_day(net_of(tiny)), tiny.today))
    assert day(activity.holder_transitions(grid), "date", "holders_in_cnt", "holders_out_cnt") == [
        (D[1], 0, 0), (D[2], 0, 0), (D[3], 1, 0), (D[4], 0, 0), (D[5], 0, -1), (D[6], 0, 0)]


def test_volume_and_price_reports(tiny):
    assert day(token.volume(tiny, "tok"), "date", "txs_cnt", "volume_token", "volume_usd") == [
        (D[1], 1, 100.0, 200.0), (D[2], 0, None, None), (D[3], 2, 50.0, 200.0), (D[4], 0, None, None),
        (D[5], 2, 35.0, None), (D[6], 0, None, None)]
    assert day(token.price_daily(tiny, "tok"), "date", "close_price")[1:4] == [(D[2], None), (D[3], 4.0), (D[4], None)]
    ma = [r.ma_5d for r in token.price_with_ma(tiny, "tok").collect()]
    assert ma[0] == 2.0 and ma[2] == 3.0


def test_average_purchase_price(spark, tiny):
    # A bought 100 at 2.0 and, without a price, 35 more, which count as tokens only.
    row = token.avg_purchase_price(tiny, "tok").collect()
    assert len(row) == 1 and row[0].balance_token == 90.0
    assert row[0].avg_purchase_price_usd == pytest.approx(200.0 / 135)
    # Equal transfers of one address on one day are not merged.
    twice = sources(spark, [(at(D[1], i), f"h{i}", B, A, "tok", 5) for i in range(2)])
    assert token.avg_purchase_price(twice, "tok").first().balance_token == 10.0


def test_as_of_prices_equal_brute_force(spark):
    """One contract has most rows, blocks lie empty between ticks, times tie, and some rows lack a time or contract."""
    rng, start = random.Random(11), dt.datetime(2024, 1, 1)

    def when():
        return start + dt.timedelta(seconds=rng.randrange(0, 200_000, 50))

    events = [(i, rng.choice(["hot"] * 6 + ["cold", "never", None]), when() if i % 50 else None) for i in range(1500)]
    ticks = [(when(), rng.choice(["hot", "cold", None]), rng.choice([None, 1.0, 2.0, 3.0, 4.0])) for _ in range(150)]
    frames = (spark.createDataFrame(events, "id int, contract_address string, evt_block_time timestamp_ntz").repartition(4),
              spark.createDataFrame(ticks, "minute timestamp_ntz, contract_address string, price double"))
    want = {}
    for i, contract, at_ in events:
        seen = [(m, p) for m, c, p in ticks if c == contract and c and p is not None and at_ and m <= at_]
        want[i] = max(seen)[1] if seen else None
    for block in (600, 3600, 10**6):
        got = prices.attach_as_of(*frames, block=block)
        assert got.columns == ["id", "contract_address", "evt_block_time", "last_price"]
        assert {r["id"]: r["last_price"] for r in got.collect()} == want
