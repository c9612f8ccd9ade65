"""Registered queries against their SQL, and the entry point."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tallyforge.catalog import ORACLES, QUERIES
from tallyforge.plans import audits

DATA = "/root/testdata/sf0.001"


def cells(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, str):
            return v
        if hasattr(v, "__len__"):
            return repr(list(v))
        return f"{float(v):.6g}"

    return sorted(tuple(map(cell, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_a_query_agrees_with_its_sql(spark, sql, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), sql.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)


@pytest.mark.parametrize("name", ["ungrounded_answers", "audit_orders"])
def test_digits_of_keys_and_dates_are_no_totals(spark, tmp_path, name):
    """Totals that the page's other digits have: in the number and date, in the line's number and amount, as the year, as a lot's number."""
    day = pd.Timestamp("1997-01-25")
    orders = [(3426829, [(5, 90000.0), (6, 1997.01)]), (7, [(34002, 104576.23), (40017, 35445.87)]), (10, [(1, 1000.0), (2, 997.0)]), (13, [(5000, 2000.0), (4, 3000.0)]), (16, [(9, 1234.5)]), (4042405, [(34002210457, 39000.0), (7, 1022.1)])]
    pd.DataFrame([(k, day) for k, _ in orders], columns=["o_orderkey", "o_orderdate"]).to_parquet(f"{tmp_path}/orders.parquet", coerce_timestamps="us")
    lines = [(k, part, n, 1.0, price) for k, rows in orders for n, (part, price) in enumerate(rows)]
    pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"]).to_parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    for table in ("orders", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    assert cells(QUERIES[name](spark, str(tmp_path)).toPandas()) == cells(db.execute(ORACLES[name]).df())


@pytest.mark.parametrize("late_first", [False, True])
def test_an_order_that_stands_twice_has_its_first_day(spark, tmp_path, late_first):
    """Whichever row is read first, so that its fields and its transcript, which are worked out apart, agree."""
    days = sorted([pd.Timestamp("1997-01-25"), pd.Timestamp("1998-12-03")], reverse=late_first)
    pd.DataFrame([(k, day) for k in (4, 6) for day in days], columns=["o_orderkey", "o_orderdate"]).to_parquet(f"{tmp_path}/orders.parquet", coerce_timestamps="us")
    lines = [(k, 5, 1, 1.0, 1000.0) for k in (4, 6)]
    pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"]).to_parquet(f"{tmp_path}/lineitem.parquet")
    fields, pages = audits.audited_orders(spark, str(tmp_path))
    assert {r[0] for r in fields.select("fields.issue_date").collect()} == {"bjjh-ab-cf"}
    assert all("bjjh-ab-cf" in r.text for r in pages.collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
