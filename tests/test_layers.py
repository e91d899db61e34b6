"""Stored views and balances: built once, extended by new days, never served stale."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chaintally import Sources
from chaintally.functions import wide
from chaintally.plans import account, token
from chaintally.sources import activity_store
from chaintally.sources.activity_store import ActivityStore
from chaintally.sources.balance_store import BalanceStore
from chaintally.sources.catalog import read_table, write_layer
from chaintally.sources.layers import LayerStore, StaleLayer
from chaintally.sources.zones import ZoneIndex
from conftest import A, B, C, D, TINY, TRANSFER, at, day, sources, table

LATER = [(at(D[8]), "t6", A, C, "tok", 25), (at(D[9]), "t7", C, B, "tok", 25), (at(D[9], 1), "t8", B, A, "tok", 1)]
REPORTS = (token.holders, token.supply_mint_burn, token.current_holders, token.top_holders_list, token.wealth_gap_balance,
           token.marketcap, token.price_daily, token.balance, token.new_holders_weekly)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def store_of(spark, tmp_path, *days, transfers=TINY + LATER):
    store = BalanceStore(spark, str(tmp_path / "balances"))
    for d in days:
        token.store_balances(sources(spark, transfers, d), "tok", store)
    return store


@pytest.mark.parametrize("days", [(D[10],), (D[6], D[10]), (D[2], D[3], D[4], D[5], D[8], D[10]), (D[1], D[7], D[9], D[10])])
def test_stored_balances_equal_the_report_however_they_grew(spark, tmp_path, days):
    src = sources(spark, TINY + LATER, D[10])
    store = store_of(spark, tmp_path, *days)
    want = rows(token.balance(src, "tok"))
    assert rows(token.balance_from_store(src, "tok", store)) == want
    for d in (D[1], D[4], D[8], D[10]):
        got = rows(token.balance_on_day(src, "tok", d, store))
        assert got == [r for r in want if r[2] == d]


def test_the_second_write_reads_no_earlier_event_and_touches_few_addresses(spark, tmp_path):
    store = store_of(spark, tmp_path, D[6], transfers=TINY)
    # the earlier events are gone; only the snapshot knows them
    token.store_balances(sources(spark, LATER, D[10]), "tok", store)
    src = sources(spark, TINY + LATER, D[10])
    assert rows(token.balance_from_store(src, "tok", store)) == rows(token.balance(src, "tok"))
    written = spark.read.parquet(store.generations()[1]["open"])
    assert sorted(r["address"] for r in written.collect()) == [A, B, C]  # the sinks did not move


def test_the_cut_reaches_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    table(spark, TINY, TRANSFER).write.parquet(str(tmp_path / "erc20_transfers"))
    src = sources(spark, TINY, D[6])
    src.tables["erc20_transfers"] = lambda: read_table(spark, str(tmp_path), "erc20_transfers")
    seen = []

    class Spy(BalanceStore):
        def append(self, legs, through):
            seen.append(legs(D[4]))

    token.store_balances(src, "tok", Spy(spark, str(tmp_path / "b")))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(evt_block_time,2024-01-04" in plan


def test_a_day_is_found_in_the_folders_that_span_it(spark, tmp_path):
    far = [(at(dt.date(2024, 6, 1)), "u1", A, B, "tok", 1), (at(dt.date(2024, 12, 1)), "u2", A, B, "tok", 1)]
    store = store_of(spark, tmp_path, dt.date(2024, 12, 31), transfers=TINY + far)
    plan = store.on_day(dt.date(2024, 6, 15))._jdf.queryExecution().executedPlan().toString()
    block = (dt.date(2024, 6, 15) - dt.date(1970, 1, 1)).days // 32
    assert f"(first_block" in plan and f"<= {block})" in plan and "PartitionFilters: [isnotnull(first_block" in plan
    assert "Generate" not in plan  # nothing is expanded to days
    assert dict(day(store.on_day(dt.date(2024, 6, 15)), "address", "balance"))[B] == 1


def test_stale_days_are_refused(spark, tmp_path):
    store = store_of(spark, tmp_path, D[6])
    with pytest.raises(StaleLayer):
        store.on_day(D[7])
    with pytest.raises(StaleLayer):
        token.store_balances(sources(spark, TINY, D[5]), "tok", store)
    with pytest.raises(StaleLayer):
        token.balance_from_store(sources(spark, TINY, D[9]), "tok", store)
    with pytest.raises(StaleLayer):
        BalanceStore(spark, str(tmp_path / "empty")).intervals()


def test_a_batch_without_a_row_in_the_manifest_does_not_count(spark, tmp_path, monkeypatch):
    store = store_of(spark, tmp_path, D[6])
    before = rows(store.intervals())

    def dies(*args):
        raise RuntimeError("lost")

    from chaintally.sources import balance_store
    with monkeypatch.context() as m:
        m.setattr(balance_store, "add_row", dies)
        with pytest.raises(RuntimeError):
            token.store_balances(sources(spark, TINY + LATER, D[10]), "tok", store)
    assert rows(store.intervals()) == before
    token.store_balances(sources(spark, TINY + LATER, D[10]), "tok", store)
    assert store.through == D[10] and len(store.generations()) == 2


def test_snapshots_are_folded(spark, tmp_path, monkeypatch):
    from chaintally.sources import balance_store
    monkeypatch.setattr(balance_store, "FOLD", 2)
    store = store_of(spark, tmp_path, *D[1:11])
    assert store.generations()[-1]["since"] >= 8
    src = sources(spark, TINY + LATER, D[10])
    assert rows(token.balance_from_store(src, "tok", store)) == rows(token.balance(src, "tok"))


def test_wide_balances_grow_too(spark, tmp_path):
    def shape(transfers, d):
        src = sources(spark, transfers, d)
        wider = src.table("erc20_transfers").withColumn("value", F.concat(F.col("value").cast("string"), F.lit("0" * 40)))
        return Sources({**src.tables, "erc20_transfers": wider}, d)

    store = BalanceStore(spark, str(tmp_path / "balances"))
    for transfers, d in ((TINY, D[6]), (LATER, D[10])):
        token.store_balances(shape(transfers, d), "tok", store)
    src = shape(TINY + LATER, D[10])
    assert isinstance(wide.of(store.intervals(), "balance"), wide.Limbs)
    assert rows(token.balance_from_store(src, "tok", store)) == rows(token.balance(src, "tok"))


def test_reports_share_one_scan_of_the_ledger(spark, tmp_path):
    plain = sources(spark, TINY + LATER, D[10])
    shared = sources(spark, TINY + LATER, D[10])
    shared.layers = LayerStore(spark, str(tmp_path / "views"))
    token.holders(shared, "tok").collect()
    # from here on the transfers cannot be read any more: their plan still names the version, their rows are gone
    for report in REPORTS:
        df = report(shared, "tok")
        assert rows(df) == rows(report(plain, "tok"))
        files = df.inputFiles()
        assert files and all("/views/" in f or "chaintally-" in f for f in files)
    kept = sorted((r["view"], r["contract"]) for r in spark.read.parquet(str(tmp_path / "views" / "manifest")).collect())
    assert kept == [("holders", "tok"), ("net_flows", "tok"), ("price_daily", "tok")]


def test_another_version_of_the_inputs_is_never_served(spark, tmp_path):
    few, many, other = (sources(spark, t, D[10]) for t in (TINY, TINY + LATER, TINY + LATER[:1]))

    def read(src, frozen):
        return rows(token.holders(Sources(src.tables, src.as_of, layers=LayerStore(spark, str(tmp_path / "views"), frozen)), "tok"))

    old, new = read(few, False), read(many, False)
    assert old != new and new == rows(token.holders(many, "tok"))
    assert read(few, True) == old and read(many, True) == new  # both versions are kept apart
    with pytest.raises(StaleLayer):
        read(other, True)


def test_a_view_of_files_is_stale_once_files_are_added(spark, tmp_path):
    path = str(tmp_path / "erc20_transfers")
    table(spark, TINY, TRANSFER).coalesce(1).write.parquet(path)

    tables = {**sources(spark, TINY, D[10]).tables, "erc20_transfers": lambda: read_table(spark, str(tmp_path), "erc20_transfers")}

    def src(frozen=True):
        return Sources(tables, D[10], layers=LayerStore(spark, str(tmp_path / "views"), frozen))

    first = rows(token.holders(src(False), "tok"))
    assert rows(token.holders(src(), "tok")) == first
    table(spark, LATER, TRANSFER).coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(StaleLayer):
        token.holders(src(), "tok")
    assert rows(token.holders(src(False), "tok")) != first


def test_rolling_counts_of_stored_days_equal_the_report(spark, tmp_path):
    src = sources(spark, TINY + LATER, D[12])
    store = ActivityStore(spark, str(tmp_path / "activity"))
    for transfers, d in ((TINY, D[3]), (TINY, D[6]), (LATER, D[8]), (LATER, D[12])):  # each batch sees no day of one before
        late = [r for r in transfers if not store.generations() or r[0].date() > store.generations()[-1]["through"]]
        token.store_activity(sources(spark, late, d), "tok", store)
    want = rows(token.active_addresses(src, "tok"))
    assert rows(token.active_addresses_from_store(src, store)) == want
    names = sorted(token.active_addresses(src, "tok").columns)
    tail = [r for r in want if r[names.index("date")] >= D[9]]
    assert rows(token.active_addresses_from_store(src, store, since=D[9])) == tail
    with pytest.raises(StaleLayer):
        token.active_addresses_from_store(sources(spark, TINY, D[13]), store)
    with pytest.raises(StaleLayer):
        token.store_activity(sources(spark, TINY, D[12]), "tok", store)


def test_keys_keep_their_numbers_across_bitmaps(spark, tmp_path, monkeypatch):
    """More keys in a bucket than a bitmap holds, some of them seen again later."""
    monkeypatch.setattr(activity_store, "BUCKETS", 1)
    store = ActivityStore(spark, str(tmp_path / "activity"))
    events = spark.range(100_000).selectExpr("CASE WHEN id < 40000 THEN date'2024-01-01' WHEN id < 70000 THEN date'2024-01-02' ELSE date'2024-01-04' END AS date",
                                             "concat('0x', id % 50000) AS who")
    for d in (D[1], D[2], D[5]):
        store.append(lambda since: events if since is None else events.filter(F.col("date") >= F.lit(since)), {"": "who"}, d)
    got = {r["date"]: (r["day"], r["two"]) for r in store.rolling({"day": 1, "two": 2}, ("",), D[5]).collect()}
    assert got == {D[1]: (40_000, 40_000), D[2]: (30_000, 50_000), D[3]: (0, 30_000), D[4]: (30_000, 30_000), D[5]: (0, 30_000)}
    assert spark.read.parquet(*[r["numbers"] for r in store.generations()]).select("number").distinct().count() == 50_000


def test_a_probe_opens_a_file_or_two(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows_ = spark.range(20_000).selectExpr("concat('0x', lpad(id % 400, 4, '0')) AS contract_address", "id AS n")
    rows_.repartitionByRange(6, "contract_address").write.parquet(path)
    rows_.filter("id = 1").withColumn("contract_address", F.lit("0xnew")).coalesce(1).write.mode("append").parquet(path)
    index = ZoneIndex(spark, path)
    files = len(index.refresh())
    assert files == 7
    for contract, there in (("0x0007", True), ("0x0399", True), ("0xnew", True), ("0x0007x", False), ("0x9", False), ("", False)):
        assert index.holds(contract) == there and index.opened <= 2
    # a file that was added is known to the next probe, one that is gone is not asked for
    rows_.filter("id = 2").withColumn("contract_address", F.lit("0xlater")).coalesce(1).write.mode("append").parquet(path)
    assert index.holds("0xlater") and len(index.refresh()) == files + 1


def test_profiles_ask_the_index_and_no_ledger(spark, tmp_path):
    write_layer(sources(spark, TINY).table("erc20_transfers"), str(tmp_path / "e"), (), cluster_by="contract_address")
    empty = spark.createDataFrame([], "contract_address string")
    empty.write.parquet(str(tmp_path / "none"))
    contracts = spark.createDataFrame([("tok", "p", "n", "d"), ("oth", "p", "n", "d")], "address string, name string, namespace string, `from` string")

    def unread():
        raise AssertionError("a ledger was read")

    names = ("erc20_transfers", "erc721_transfers", "erc1155_single", "erc1155_batch")
    src = Sources({**dict.fromkeys(names, unread), "contracts": contracts}, D[6])
    src.zones = {n: ZoneIndex(spark, str(tmp_path / ("e" if n == names[0] else "none"))) for n in names}
    assert account.contract_profile(src, "tok").first()["contract_type"] == "ERC-20"
    assert account.contract_profile(src, "oth").first()["contract_type"] == "Unknown"


def test_a_heavy_value_is_split_among_files_that_the_index_finds(spark, tmp_path):
    df = spark.range(4000).select(
        F.when(F.col("id") < 3900, "heavy").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("contract_address"),
        F.array("id").alias("ids"), F.create_map(F.lit("k"), F.col("id")).alias("note"))
    path, switch = str(tmp_path / "e"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(switch, "false")
    try:
        back = write_layer(df, path, (), cluster_by="contract_address")
    finally:
        spark.conf.unset(switch)
    per_file = [r["count"] for r in back.filter("contract_address = 'heavy'").groupBy(F.input_file_name()).count().collect()]
    assert back.count() == 4000 and len(per_file) > 2 and max(per_file) < 2000
    index = ZoneIndex(spark, path)
    assert index.holds("heavy") and index.opened == 2 and len(index.candidates("heavy")) == len(per_file)
    assert index.holds("c3950") and index.opened <= 2 and not index.holds("none")
    zones = spark.read.parquet(index.path)
    assert zones.count() == len(back.inputFiles())
    assert {(r["least"], r["most"]) for r in back.groupBy(F.input_file_name()).agg(F.min("contract_address").alias("least"), F.max("contract_address").alias("most")).collect()} == {
        (r["least"], r["most"]) for r in zones.collect()}
