import random

import pytest
from pyspark.sql import functions as F, Window as W

from chaintally.operators import ranking, stats
from conftest import A, B, C, D, day


def test_latest_per_key_and_top_n(spark):
    df = spark.createDataFrame([("a", D[1], 5), ("a", D[2], None), ("b", D[1], 7)], "k string, date date, v int")
    assert day(ranking.latest_per_key(df, ["k"]), "k", "date", "v") == [("a", D[2], None), ("b", D[1], 7)]
    out = ranking.top_n(df, [ranking.descending("v"), ranking.ascending("k")], 2).collect()
    assert [r.v for r in out] == [7, 5]


def test_top_labels_break_ties_by_key_and_sum_the_rest(spark):
    df = spark.createDataFrame([(D[1], f"k{i:02d}", 5) for i in range(12)] + [(D[2], "k00", None), (D[2], "k01", 3)],
                               "date date, address string, v long")
    out = dict(((r.date, r.top10), r.v) for r in ranking.topn_with_others(df, "v").collect())
    assert out[(D[1], "(Others)")] == 10 and out[(D[1], "Top10")] == 5
    assert {k: v for k, v in out.items() if k[0] == D[2]} == {(D[2], "Top01"): 3, (D[2], "Top02"): None}
    top = ranking.top_ranks(df, "v", n=2).filter(F.col("date") == D[1])
    assert day(top, "rank", "address") == [(1, "k00"), (2, "k01")]


def test_dense_labels_for_a_population_without_activity(spark):
    per = spark.createDataFrame([(D[1], "a", 4)], "date date, address string, v long")
    days = spark.createDataFrame([(D[1], 4, 1), (D[2], None, 0)], "date date, _all long, _filled long")
    top = ranking.top_ranks(per, "v", n=2)
    zero = ranking.label_tops(top, days, F.lit(5), "v", n=2, fill=0)
    assert day(zero, "date", "top10", "v") == [
        (D[1], "(Others)", 0), (D[1], "Top1", 4), (D[1], "Top2", 0),
        (D[2], "(Others)", 0), (D[2], "Top1", 0), (D[2], "Top2", 0)]
    assert day(ranking.label_tops(top, days, F.lit(2), "v", n=2), "date", "top10", "v")[-1] == (D[2], "Top2", None)


def test_share_of_total(spark):
    df = spark.createDataFrame([(D[1], 1), (D[1], 3), (D[2], 0)], "date date, v long")
    assert day(ranking.share_of_total(df, "v"), "v", "share") == [(0, 0.0), (1, 0.25), (3, 0.75)]
    assert day(ranking.share_of_total(df, "v", "date"), "date", "share") == [(D[1], 0.25), (D[1], 0.75), (D[2], None)]


def test_hhi_bounds_and_empty_total(spark):
    df = spark.createDataFrame([(D[1], 1), (D[1], 1), (D[2], 4), (D[3], 0)], "date date, balance long")
    assert day(ranking.hhi(df), "date", "hhi") == [(D[1], 0.5), (D[2], 1.0), (D[3], None)]


@pytest.mark.parametrize("rows", [1, 2, 11, 500])
def test_positions_and_classes_equal_one_global_window(spark, rows):
    """A third of all rows share one value; positions still split it and classes fold it."""
    rng = random.Random(rows)
    data = [(f"k{i:04d}", 0 if i % 3 == 0 else rng.randint(-50, 50)) for i in range(rows)]
    df = spark.createDataFrame(data, "address string, v long")
    got = ranking.cumulative_position(df, [ranking.ascending("v"), ranking.ascending("address")])
    want = sorted(data, key=lambda r: (r[1], r[0]))
    placed = sorted((r.address_idx, r.address, r.address_idx_cumulative_dist) for r in got.collect())
    assert placed == [(i + 1, k, (i + 1) / rows) for i, (k, _) in enumerate(want)]
    pr = df.withColumn("p", F.percent_rank().over(W.orderBy("v")))
    band = F.lit(None).cast("string")
    for edge, label in reversed(ranking.class_labels()):
        band = F.when(F.col("p") <= edge, label).otherwise(band)
    want = pr.groupBy(band.alias("class")).agg(
        F.min("v").alias("value_min"), F.max("v").alias("value_max"), F.count("address").alias("address_cnt"))
    got = ranking.percentile_class(df, "v", "v")
    cols = ("class", "value_min", "value_max", "address_cnt")
    assert day(got, *cols) == day(want, *cols)
    assert got.agg(F.sum("address_cnt")).first()[0] == rows


def test_null_measures_rank_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("c", 2)], "address string, v long")
    got = ranking.cumulative_position(df, [ranking.ascending("v"), ranking.ascending("address")])
    assert [r.address for r in got.orderBy("address_idx").collect()] == ["b", "c", "a"]


def test_class_labels():
    assert ranking.class_labels()[0] == (0.1, "TOP 100%") and ranking.class_labels()[-1] == (1.0, "TOP 10%")


def test_segments(spark):
    df = spark.createDataFrame([(D[1], A, 1), (D[1], A, 1), (D[1], B, 0)], "date date, address string, v int")
    out = stats.segment_counts(df, {"some": F.col("v") > 0, "none": F.col("v") == 0})
    assert day(out, "date", "some", "none") == [(D[1], 1, 1)]


def test_holdings_distribution_fills_sizes_and_starts_at_one(spark):
    df = spark.createDataFrame([("a", 2), ("b", 2), ("c", 4), ("d", -3), ("e", 0)], "address string, nfts_cnt long")
    cols = ("nfts_cnt", "address_cnt", "cum_nfts_cnt", "cum_address_cnt", "cum_address_share")
    rows = day(stats.holdings_distribution(df), *cols)
    assert [r[:4] for r in rows] == [(1, 0, 0, 0), (2, 2, 4, 2), (3, 0, 4, 2), (4, 1, 8, 3)]
    assert rows[-1][4] == 1.0
    wide = day(stats.holdings_distribution(df, include_nonpositive=True), *cols)
    assert [r[:2] for r in wide[:5]] == [(-3, 0), (-2, 0), (-1, 0), (0, 0), (1, 0)]
    only = spark.createDataFrame([("a", 2)], "address string, nfts_cnt long")
    assert [r[0] for r in day(stats.holdings_distribution(only), *cols)] == [2]


def test_confidence_band(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (50.0,)], "v double")
    rows = stats.confidence_band(df, "v", z=0.5).orderBy("v").collect()
    assert [r.confidence_group for r in rows] == ["Abnormal", "Abnormal", "Abnormal", "Abnormal"]
    wide = stats.confidence_band(df, "v").orderBy("v").collect()
    mean, half = 14.0, 2.58 * 24.0138 / 2
    assert wide[0].confidence_lower == pytest.approx(mean - half, rel=1e-3)
    assert {r.confidence_group for r in wide[:3]} == {"Normal"}


def test_trade_measures(spark):
    df = spark.createDataFrame(
        [("p", "buy", A, "t1", 1.0, 2.0), ("p", "buy", A, "t1", 1.0, 2.0), ("p", "buy", B, "t2", 1.0, None),
         ("p", "sell", A, "t3", 4.0, 5.0), (None, "sell", A, "t4", 1.0, 1.0)],
        "k string, trade_type string, address string, tx_hash string, amount_token double, amount_usd double")
    rows = {r.k: r for r in stats.trade_measures(df, ["k"], negate_sell=True).collect()}
    p, none = rows["p"], rows[None]
    assert (p.addresses_cnt_buy, p.txs_cnt_buy, p.tx_volume_token_buy, p.tx_volume_usd_buy) == (2, 2, 3.0, 4.0)
    assert (p.addresses_cnt_sell, p.tx_volume_usd_sell) == (-1, -5.0)
    assert (none.txs_cnt_buy, none.tx_volume_usd_buy, none.txs_cnt_sell) == (0, None, -1)


def test_current_balance_treats_missing_totals_as_zero(spark):
    who = spark.createDataFrame([(A,), (B,), (C,)], "address string")
    totals = spark.createDataFrame([(A, 5, None), (B, 1, 4)], "address string, i long, o long")
    assert day(stats.current_balance(who, totals, "i", ["o"]), "address", "balance") == [(A, 5), (B, -3), (C, 0)]
    assert day(stats.current_balance(who, totals, "i", ["o"], positive=True), "address") == [(A,)]


def test_hhi_of_amounts_with_eighteen_decimals(spark):
    df = spark.createDataFrame([(D[1], f"0x{i}", str(11 * 10 ** 18)) for i in range(4)], "date date, address string, balance string")
    assert day(ranking.hhi(df.withColumn("balance", F.col("balance").cast("decimal(38,0)"))), "date", "hhi") == [(D[1], 0.25)]


def test_wide_gap_between_holding_sizes(spark):
    df = spark.createDataFrame([("0x1", 1), ("0x2", 3_000_000)], "address string, nfts_cnt long")
    got = stats.holdings_distribution(df)
    assert got.count() == 3_000_000
    assert day(got.filter("nfts_cnt IN (1, 2, 2999999, 3000000)"), "nfts_cnt", "address_cnt") == [(1, 1), (2, 0), (2999999, 0), (3000000, 1)]


def test_the_middle_is_exact_for_days_of_any_size(spark):
    """One day with two thirds of all rows and few values, days of one row, ties, NULL values."""
    rng = random.Random(8)
    rows = [(rng.choice([1] * 8 + [2, 3, 4, 5]), rng.choice([None] + [round(rng.random() * 50) / 2 for _ in range(30)])) for _ in range(6000)]
    rows += [(6, 1.5), (7, None), (8, 2.0), (8, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "date int, v double").repartition(7)
    want = {}
    for part in {r[0] for r in rows}:
        found = sorted(v for p, v in rows if p == part and v is not None)
        if found:
            want[part] = found[(len(found) + 1) // 2 - 1]
    assert {r["date"]: r["median"] for r in ranking.middle(df, "date", "v").collect()} == want
    assert ranking.middle(df.limit(0), "date", "v").count() == 0


def test_positions_come_out_in_order_without_a_second_sort(spark):
    df = spark.range(5000).selectExpr("concat('0x', id * 7919 % 5000) AS address", "id % 3 AS balance").repartition(5)
    placed = ranking.cumulative_position(df, [ranking.ascending("balance"), ranking.ascending("address")])
    rows = placed.collect()
    assert [r["address_idx"] for r in rows] == list(range(1, 5001))
    assert [(r["balance"], r["address"]) for r in rows] == sorted((r["balance"], r["address"]) for r in rows)
    assert "rangepartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
