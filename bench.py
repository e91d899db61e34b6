"""Times the headline reports and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from chaintally.session import build_session  # noqa: E402
from verification.queries import all_queries  # noqa: E402

HEADLINE = [
    "r01_transfers", "r03_balance_orders", "r05_holders", "r06_supply_mint_burn", "r07_overlap_erc20",
    "r09_active_addresses", "r10_avg_purchase_price", "r11_current_holders", "r14_new_holders_monthly",
    "r17_top_holders_list", "r18_wealth_gap_txs", "r20_wealth_gap_balance_orders",
    "r25_dex_dominance_daily", "r28_marketcap", "r30_volume", "r36_account_balance_erc20",
    "r40_cohort_token_class_click", "r41_cohort_nft_overlap", "r43_derivative_items",
    "r47_hhi_daily_main", "r49_holders_main", "r50_nft_price_volume", "r51_nft_token_stats",
    "r52_contract_active_users",
]


def main():
    cpus = os.environ.get("BENCH_CPUS", "8")
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found = all_queries()

    def run(name):
        began = time.perf_counter()
        found[name](spark, root).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name in names:
        times[name] = round(min(run(name) for _ in range(3)), 3)
    print(json.dumps({
        "metric": "headline reports, best of three runs each, summed",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
