"""Every registered ledger query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from conftest import TESTDATA
from verification import oracle, queries
from verification.compare import compare, connect

ROOT = os.environ.get("ORACLE_SF_DIR", f"{TESTDATA}/sf0.001")
QUERIES, ORACLE = queries.all_queries(), oracle.sql()


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())
    ids = {name.split("_")[0] for name in QUERIES}
    assert ids == {f"a{i:02d}" for i in range(1, 15)} | {f"t{i:02d}" for i in range(1, 43)} | {f"r{i:02d}" for i in range(1, 56)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, ROOT), con, ORACLE[name]) is None


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["token_ca", "token_symbol", "address", "balance_token", "share"]
    assert 0 < df.count() <= 10
