"""Runs a query in Spark and its SQL in DuckDB and reports the first difference."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def connect(root):
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(table, key=repr)


def same(a, b, tolerance):
    if isinstance(a, float) and isinstance(b, float) and tolerance:
        return abs(a - b) <= tolerance * max(1.0, abs(a))
    return a == b and type(a) is type(b)


def compare(df, con, sql, tolerance=0.0):
    """None when equal, otherwise a description of what differs."""
    spark_names, spark_rows = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    sql_names, sql_rows = rows_of([c[0] for c in result.description], result.fetchall())
    if spark_names != sql_names:
        return f"columns {spark_names} against {sql_names}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows against {len(sql_rows)}"
    for left, right in zip(spark_rows, sql_rows):
        if not all(same(a, b, tolerance) for a, b in zip(left, right)):
            return f"{left} against {right}"
    return None
