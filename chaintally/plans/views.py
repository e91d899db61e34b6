"""Ledger layers under fixed names, for people who would rather write SQL."""

from __future__ import annotations

from chaintally.plans import token as reports

LAYERS = {
    "transfers": reports.transfers, "trades": reports.trades, "balance": reports.balance,
    "price_daily": reports.price_daily, "holders": reports.holders,
    "supply_mint_burn": reports.supply_mint_burn,
}


def register_layers(src, token, names=("transfers", "price_daily", "holders", "supply_mint_burn"),
                    prefix=""):
    """Register layers of one token as temporary views and return them by name.

    The daily balance is the size of the whole calendar grid, so it is made on request only.
    """
    frames = {name: LAYERS[name](src, token) for name in names}
    for name, df in frames.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return frames
