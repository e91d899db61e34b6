import datetime as dt
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chaintally import Sources  # noqa: E402
from chaintally.constants import DEAD_ADDRESS, ZERO_ADDRESS  # noqa: E402
from chaintally.session import build_session  # noqa: E402

TESTDATA = "/root/testdata"
A, B, C = "0xa", "0xb", "0xc"
D = [None] + [dt.date(2024, 1, i) for i in range(1, 32)]


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def at(date, second=0):
    return dt.datetime.combine(date, dt.time(0, 0, second))


TRANSFER = ("evt_block_time timestamp_ntz, evt_tx_hash string, `from` string, `to` string, "
            "contract_address string, value raw")


def table(spark, rows, ddl):
    """A literal frame; columns of type ``raw`` are the ledger's integer amounts."""
    wide = [c.split()[0] for c in ddl.split(", ") if c.split()[1] == "raw"]
    df = spark.createDataFrame(rows, ddl.replace(" raw", " long"))
    return df.withColumns({c: F.col(c).cast("decimal(38,0)") for c in wide}) if wide else df



# A mint of 100, two payments, a burn of 10 and a transfer to oneself.
TINY = [
    (at(D[1]), "t1", ZERO_ADDRESS, A, "tok", 100),
    (at(D[3]), "t2", A, B, "tok", 40),
    (at(D[3], 1), "t3", B, DEAD_ADDRESS, "tok", 10),
    (at(D[5]), "t4", B, A, "tok", 30),
    (at(D[5], 1), "t5", A, A, "tok", 5),
]


@pytest.fixture(scope="session")
def tiny(spark):
    return sources(spark, TINY)


def sources(spark, transfers, as_of=D[6], **extra):
    meta = spark.createDataFrame(
        [("tok", "TOK", 0, "ethereum"), ("oth", "OTH", 1, "ethereum"), ("far", "FAR", 0, "elsewhere")],
        "contract_address string, symbol string, decimals int, blockchain string")
    ticks = spark.createDataFrame(
        [(at(D[1], 1), "ethereum", "tok", "TOK", 1.0), (at(D[1], 9), "ethereum", "tok", "TOK", 2.0),
         (at(D[3], 1), "ethereum", "tok", "TOK", 4.0), (at(D[4], 1), "ethereum", "tok", "TOK", None)],
        "minute timestamp_ntz, blockchain string, contract_address string, symbol string, price double")
    tables = {"erc20_transfers": table(spark, transfers, TRANSFER), "tokens_erc20": meta, "prices_usd": ticks}
    tables.update(extra)
    return Sources(tables, as_of)


def item_table(spark, rows):
    return spark.createDataFrame(
        [(at(d), h, s, r, ca, n) for n, (d, h, s, r, ca) in enumerate(rows)],
        "evt_block_time timestamp_ntz, evt_tx_hash string, `from` string, `to` string, "
        "contract_address string, tokenId long")
