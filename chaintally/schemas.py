"""Column layout of every source table, and the check made where a frame enters the library."""

from __future__ import annotations

from pyspark.sql import types as T

# Amounts are whole numbers of up to 256 bits: decimals, or text where 38 digits do not hold
# them. Item ids are names of that width and always text.
RAW = T.DecimalType(38, 0)


def _struct(**fields):
    return T.StructType([T.StructField(name.rstrip("_"), kind) for name, kind in fields.items()])


_S, _TS, _D, _DBL, _L, _I = (
    T.StringType(), T.TimestampType(), T.DateType(), T.DoubleType(), T.LongType(), T.IntegerType(),
)

SOURCES = {
    "erc20_transfers": _struct(
        evt_block_time=_TS, evt_tx_hash=_S, from_=_S, to=_S, contract_address=_S, value=RAW),
    "erc721_transfers": _struct(
        evt_block_time=_TS, evt_tx_hash=_S, from_=_S, to=_S, contract_address=_S, tokenId=_S),
    "erc1155_single": _struct(
        evt_block_time=_TS, evt_tx_hash=_S, from_=_S, to=_S, contract_address=_S, id=_S, value=RAW),
    "erc1155_batch": _struct(
        evt_block_time=_TS, evt_tx_hash=_S, from_=_S, to=_S, contract_address=_S,
        ids=T.ArrayType(_S), values=T.ArrayType(RAW)),
    "traces": _struct(
        block_time=_TS, tx_hash=_S, from_=_S, to=_S, value=RAW, input=T.BinaryType(), type=_S,
        call_type=_S, success=T.BooleanType()),
    "gas_fees": _struct(
        tx_hash=_S, blockchain=_S, tx_sender=_S, gas_price_gwei=_DBL, gas_used=_L),
    "prices_usd": _struct(
        minute=_TS, blockchain=_S, contract_address=_S, symbol=_S, price=_DBL),
    "tokens_erc20": _struct(contract_address=_S, symbol=_S, decimals=_I, blockchain=_S),
    "tokens_nft": _struct(contract_address=_S, name=_S, blockchain=_S),
    "dex_trades": _struct(
        block_date=_D, blockchain=_S, project=_S, tx_hash=_S, tx_from=_S, token_bought_address=_S,
        token_sold_address=_S, token_bought_symbol=_S, token_sold_symbol=_S,
        token_bought_amount=_DBL, token_sold_amount=_DBL, amount_usd=_DBL),
    "nft_trades": _struct(
        block_date=_D, block_time=_TS, blockchain=_S, nft_contract_address=_S, token_id=_S,
        tx_hash=_S, tx_from=_S, tx_to=_S, amount_usd=_DBL, platform_fee_amount_usd=_DBL,
        royalty_fee_amount_usd=_DBL),
    "contracts": _struct(address=_S, name=_S, namespace=_S, from_=_S),
}

# The column that tells when a row happened, for tables that grow with the chain. Fees may
# lack it; they are then cut by the transactions they belong to.
EVENT_TIME = {
    "erc20_transfers": "evt_block_time", "erc721_transfers": "evt_block_time",
    "erc1155_single": "evt_block_time", "erc1155_batch": "evt_block_time",
    "traces": "block_time", "prices_usd": "minute", "dex_trades": "block_date",
    "nft_trades": "block_date", "gas_fees": "block_time",
}

ADDRESS_COLUMNS = {
    "erc20_transfers": ("evt_tx_hash", "from", "to", "contract_address"),
    "erc721_transfers": ("evt_tx_hash", "from", "to", "contract_address"),
    "erc1155_single": ("evt_tx_hash", "from", "to", "contract_address"),
    "erc1155_batch": ("evt_tx_hash", "from", "to", "contract_address"),
    "traces": ("tx_hash", "from", "to"),
    "gas_fees": ("tx_hash", "tx_sender"),
    "prices_usd": ("contract_address",),
    "tokens_erc20": ("contract_address",),
    "tokens_nft": ("contract_address",),
    "dex_trades": ("tx_hash", "tx_from", "token_bought_address", "token_sold_address"),
    "nft_trades": ("nft_contract_address", "tx_hash", "tx_from", "tx_to"),
    "contracts": ("address", "from"),
}


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
_TIMES = (T.TimestampType, T.TimestampNTZType)
_ACCEPTED = (
    (T.ArrayType, (T.ArrayType,)), (T.DecimalType, (*_WHOLE, T.StringType)), (T.TimestampType, _TIMES),
    (T.DateType, (T.DateType, *_TIMES)), (T.DoubleType, (T.DoubleType, T.FloatType, *_WHOLE)),
    (T.IntegerType, _WHOLE), (T.LongType, _WHOLE), (T.BooleanType, (T.BooleanType,)),
    (T.StringType, (T.StringType, T.BinaryType, *_WHOLE)), (T.BinaryType, (T.BinaryType, T.StringType)),
)


def accepts(wanted, found):
    """Whether a column of type ``found`` can stand for the declared type."""
    if isinstance(wanted, T.ArrayType) and isinstance(found, T.ArrayType):
        return accepts(wanted.elementType, found.elementType)
    return next(isinstance(found, kinds) for kind, kinds in _ACCEPTED if isinstance(wanted, kind))


def require_columns(df, wanted, what="frame"):
    """Refuse a frame that lacks a column or has one of a type that would fail or shift later."""
    names = wanted.names if isinstance(wanted, T.StructType) else list(wanted)
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")
    if isinstance(wanted, T.StructType):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        wrong = {f.name: kinds[f.name].simpleString() for f in wanted.fields if not accepts(f.dataType, kinds[f.name])}
        if wrong:
            raise ValueError(f"{what} has columns of a wrong type: {wrong}")
    return df
