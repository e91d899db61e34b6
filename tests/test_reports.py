import pytest
from pyspark.sql import functions as F

from chaintally.constants import DEAD_ADDRESS, ZERO_ADDRESS
from chaintally.plans import account, collection, token
from conftest import A, B, C, D, TRANSFER, at, day, item_table, sources, table

TRACE = ("block_time timestamp_ntz, tx_hash string, `from` string, `to` string, value raw, "
         "input string, type string, call_type string, success boolean")
GAS = "tx_hash string, blockchain string, tx_sender string, gas_price_gwei double, gas_used long"
ETH = 10 ** 18


@pytest.fixture(scope="module")
def chain(spark, tiny):
    """One transaction of A with three internal calls, and one of B that pays A."""
    traces = table(spark, [
        (at(D[1]), "x1", A, B, ETH, "i", "call", "call", True),
        (at(D[1]), "x1", A, C, ETH // 2, "i", "call", None, True),
        (at(D[1]), "x1", A, C, ETH, "i", "call", "delegatecall", True),
        (at(D[3]), "x2", B, A, 3 * ETH, "i", "call", "call", True)], TRACE)
    gas = spark.createDataFrame([("x1", "ethereum", A, 100.0, 1000000), ("x2", "ethereum", B, 100.0, 1000000)], GAS)
    return sources(spark, [
        (at(D[1]), "t1", ZERO_ADDRESS, A, "tok", 100), (at(D[2]), "t2", A, B, "tok", 40),
        (at(D[2]), "t3", C, A, "oth", 25), (at(D[3]), "t4", C, A, "nameless", 9)],
        traces=traces, gas_fees=gas)


def test_fee_is_charged_once_per_transaction(chain):
    rows = account.account_transfers_eth(chain, A)
    assert [r.gas_eth for r in rows.filter("transfer_type = 'from'").orderBy(F.col("gas_eth").desc()).collect()] == [
        0.1, None]
    assert day(account.account_balance_eth(chain, A), "date", "balance_eth") == [
        (D[1], -1.6), (D[2], -1.6), *[(D[i], 1.4) for i in range(3, 7)]]
    repeated = dict(day(account.account_balance_eth(chain, A, gas="per_trace"), "date", "balance_eth"))
    assert repeated[D[1]] == pytest.approx(-1.7)


def test_native_overlap_of_holders(chain):
    assert day(token.overlap_eth(chain, "tok"), "address", "balance_eth") == [(A, 1.4)]
    rows = token.other_coins_eth(chain, "tok").collect()
    assert [(r.address_idx, r.address, r.balance_eth) for r in rows] == [(1, B, -2.1), (2, A, 1.4)]


def test_token_overlap_needs_metadata_but_not_a_price(chain):
    rows = day(token.overlap_erc20(chain, "tok"), "address", "contract_address", "balance_token", "balance_usd")
    assert rows == [(A, "oth", 2.5, None), (A, "tok", 60.0, 240.0), (B, "tok", 40.0, 160.0)]
    assert token.overlap_erc20(chain, "tok", drop_unpriced=True).count() == 2


def test_other_coin_uses_the_latest_price(chain):
    rows = token.other_coins_erc20(chain, "tok", "tok").collect()
    assert [(r.address, r.balance_usd) for r in rows] == [(B, 160.0), (A, 240.0)]
    none = token.other_coins_erc20(chain, "tok", "oth").collect()
    assert [(r.address, r.balance_token, r.balance_usd) for r in none] == [(B, 0.0, 0.0), (A, 2.5, 0.0)]


def test_account_balance_and_views(chain):
    rows = day(account.account_balance_erc20(chain, A), "contract_address", "date", "balance_token", "balance_usd")
    oth = [r[2] for r in rows if r[0] == "oth"]
    assert oth == [None, 2.5, 2.5, 2.5, 2.5, 2.5]
    assert [r for r in rows if r[0] == "tok"][:3] == [("tok", D[1], 100.0, 200.0), ("tok", D[2], 60.0, None),
                                                      ("tok", D[3], 60.0, 240.0)]
    view = account.balance_erc20_view(chain, A)
    assert view.filter("contract_address = 'nameless'").first().symbol == "nameless"
    assert view.filter("balance_token IS NULL OR balance_usd IS NULL").count() == 0
    assert dict(day(account.balance_erc20_total(chain, A), "date", "balance_usd"))[D[2]] is None
    assert account.account_balance_erc20(chain, A, drop_unpriced=True).count() == 3
    assert account.account_transfers_erc20(chain, A).count() == 4


def test_users_of_a_contract(chain):
    assert day(account.contract_active_users(chain, C), "date", "dau", "wau", "mau")[:2] == [(D[1], 1, 1, 1), (D[2], 0, 1, 1)]
    assert day(account.contract_cumulative_users(chain, A), "date", "dau", "cumulative_dau") == [
        (D[3], 1, 1), (D[4], 0, 1), (D[5], 0, 1), (D[6], 0, 1)]


def test_contract_profile_precedence(spark):
    multi = "evt_block_time timestamp_ntz, evt_tx_hash string, `from` string, `to` string, contract_address string, "
    src = sources(
        spark, [(at(D[1]), "t", A, B, "both", 1)],
        erc721_transfers=item_table(spark, [(D[1], "t", A, B, "both"), (D[1], "t", A, B, "item")]),
        erc1155_single=table(spark, [], multi + "id raw, value raw"),
        erc1155_batch=spark.createDataFrame(
            [(at(D[1]), "t", A, B, "many", [1], [2])], multi + "ids array<long>, values array<long>"),
        contracts=spark.createDataFrame(
            [(c, n, "ns", A) for c in ("both", "item", "many", "none") for n in ("zz", "aa")],
            "address string, name string, namespace string, `from` string"))
    for contract, kind in (("both", "ERC-20"), ("item", "ERC-721"), ("many", "ERC-1155"), ("none", "Unknown")):
        rows = account.contract_profile(src, contract).collect()
        assert [(r.project, r.contract_type) for r in rows] == [("aa", kind)]
    batch = account.account_transfers_erc1155(src, A)
    assert day(batch, "transfer_type", "id", "value") == [("batch", 1, 2)]


MOVES = [(D[1], "m1", ZERO_ADDRESS, A, "main"), (D[1], "m2", ZERO_ADDRESS, A, "main"),
         (D[2], "m3", ZERO_ADDRESS, B, "side"), (D[3], "m4", A, B, "main"), (D[4], "m5", A, DEAD_ADDRESS, "main"),
         (D[4], "m6", ZERO_ADDRESS, A, "third"), (D[5], "m7", ZERO_ADDRESS, B, "foreign"),
         (D[5], "m8", ZERO_ADDRESS, C, "foreign")]
FAMILY = {"main": "main", "side": "side", "third": "third"}


@pytest.fixture(scope="module")
def items(spark):
    nft = spark.createDataFrame([("other", "X", "ethereum")], "contract_address string, name string, blockchain string")
    return sources(spark, [], erc721_transfers=item_table(spark, MOVES), tokens_nft=nft)


def test_collection_daily_reports(items):
    assert day(collection.holders_main(items, "main"), "date", "holders_cnt", "holders_dod", "holders_dod_group") == [
        (D[1], 1, None, "negative"), (D[2], 1, 0, "negative"), (D[3], 2, 1, "positive"), (D[4], 1, -1, "negative"),
        (D[5], 1, 0, "negative"), (D[6], 1, 0, "negative")]
    assert day(collection.holders_in_out(items, "main"), "date", "holders_in_cnt", "holders_out_cnt") == [
        (D[1], 0, 0), (D[2], 0, 0), (D[3], 1, 0), (D[4], 0, -1), (D[5], 0, 0), (D[6], 0, 0)]
    hhi = collection.hhi_daily(items, "main", since=D[2])
    assert day(hhi, "date", "hhi") == [(D[3], 0.5), (D[4], 1.0), (D[5], 1.0), (D[6], 1.0)]
    assert hhi.columns[2:] == ["0.01 Line", "0.15 Line", "0.25 Line"]
    assert day(collection.derivative_items(items, FAMILY), "date", "main", "main_third", "main_side", "main_side_third") == [
        (D[1], 1, 0, 0, 0), (D[2], 1, 0, 0, 0), (D[3], 1, 0, 1, 0), (D[4], 1, 0, 1, 0), (D[5], 1, 0, 1, 0),
        (D[6], 1, 0, 1, 0)]


def test_the_dead_address_is_a_holder_in_the_derivative_report_unless_excluded(items):
    out = collection.derivative_items(items, FAMILY, exclude=(ZERO_ADDRESS, DEAD_ADDRESS))
    assert day(out, "date", "main", "main_side")[-1] == (D[6], 0, 1)


def test_collection_holder_lists(items):
    rows = collection.each_holder(items, FAMILY).collect()
    assert [(r.main_cnt, r.side_cnt, r.third_cnt) for r in rows] == [(1, 1, 0), (0, 0, 1)]
    assert rows[0].address.startswith('<a href="https://etherscan.io/address/0xb"')
    overlap = collection.cohort_nft_overlap(items, "main", ("side", "third")).collect()
    assert [(r.contract_address, r["name"], r.address_cnt, r.address_share) for r in overlap] == [
        ("foreign", None, 1, 1.0)]
    assert collection.cohort_nft_overlap(items, "main", ("side", "third"), drop_unlabelled=True).count() == 0


def test_account_items(items):
    rows = day(account.account_balance_erc721(items, B), "contract_address", "date", "balance_token")
    assert [r[2] for r in rows if r[0] == "main"] == [None, 1, 1, 1, 1]
    assert account.account_transfers_erc721(items, B, oriented=True).columns[1:3] == ["ca_address", "transfer_type"]


SALE = ("block_date date, block_time timestamp_ntz, blockchain string, nft_contract_address string, token_id long, "
        "tx_hash string, tx_from string, tx_to string, amount_usd double, platform_fee_amount_usd double, "
        "royalty_fee_amount_usd double")


@pytest.fixture(scope="module")
def market(spark):
    def sale(d, t, tx, usd, seller=A, sec=0):
        return (d, at(d, sec), "ethereum", "main", t, tx, seller, B, usd, None, None)

    rows = [sale(D[1], 1, "s1", 10.0), sale(D[1], 2, "s1", 30.0), sale(D[1], 1, "s2", 50.0, sec=5),
            sale(D[4], 1, "s3", 20.0), sale(D[4], 3, "s4", 0.0), sale(D[5], 1, "s5", 99.0, ZERO_ADDRESS),
            sale(D[5], 1, "s6", None), sale(D[5], 1, None, 7.0), sale(D[5], 1, "s7", 7.0, None)]
    return sources(spark, [], nft_trades=spark.createDataFrame(rows, SALE))


def test_sales_series_repeats_prices_but_not_volume(market):
    rows = collection.nft_price_volume(market, "main").collect()
    assert [r.block_date for r in rows] == [D[i] for i in range(6, 0, -1)]
    quiet, first = rows[3], rows[5]
    assert (quiet.min_price_usd, quiet.max_price_usd, quiet.tx_count, quiet.tx_volume_usd) == (10.0, 50.0, 0, None)
    assert (first.median_price_usd, first.tx_count, first.tx_volume_usd) == (30.0, 2, 90.0)
    assert rows[0].min_price_usd_ma_7d == pytest.approx((10 * 3 + 0 * 3) / 6)
    assert rows[0].median_price_usd == 0.0  # of 0 and 20, the one that half do not exceed


def test_token_stats_recent_price_and_zero_low(market):
    rows = {int(r.token_id): r for r in collection.nft_token_stats(market, "main").collect()}
    assert (rows[1].recent_price_usd, rows[1].min_price_usd, rows[1].max_price_usd) == (20.0, 10.0, 50.0)
    assert (rows[1].price_rate_high_low, rows[1].price_rate_recent_low, rows[1].tx_count) == (4.0, 1.0, 3)
    assert rows[3].price_rate_high_low is None
    assert rows[1].recent_trade_date == D[4]


def test_cohort_classes_count_every_holder(spark, items):
    src = sources(spark, [(at(D[1]), "t", ZERO_ADDRESS, A, "tok", 7)],
                  erc721_transfers=item_table(spark, [(D[1], f"m{i}", ZERO_ADDRESS, f"p{i}", "main") for i in range(30)]
                                              + [(D[1], "ma", ZERO_ADDRESS, A, "main")]))
    rows = collection.cohort_token_class(src, "main", "tok", 0, "TOK").collect()
    assert [(r["class"], r.address_cnt, r.token_balance_usd_max) for r in rows] == [
        ("TOP 100%", 30, 0.0), ("TOP 10%", 1, 28.0)]
    wrong = collection.cohort_token_class(src, "main", "tok", 0, "NOPE").collect()
    assert sum(r.address_cnt for r in wrong) == 31 and {r.token_balance_usd_min for r in wrong} == {None}
