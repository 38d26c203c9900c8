"""Named queries against their SQL text on the smallest data folder."""

import datetime as dt
import decimal
import os

import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
CHECKED = (
    "ledger_page", "price_upsert", "metadata_upsert", "asset_classes", "trading_days", "row_validation", "oversold_sales",
    "unpriced_holdings", "prices_asof", "market_values", "cash_report", "allocation", "realized_gains", "fifo_metrics",
    "account_status", "income", "daily_returns", "performance_report", "sector_exposure", "correlation_matrix",
    "required_checkpoints", "changed_ledger", "macro_regime", "buy_map", "technicals", "tick_closes",
    "unpriced_days", "guarded_returns", "sector_weight_items", "realized_gains_by_year",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(value) + 0.0
    if isinstance(value, dt.datetime) and value.time() == dt.time():
        return str(value.date())
    return str(value)


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_query_has_its_sql():
    corpus = lambda name: name == "pipeline" or name[:2] == "op" and name[2].isdigit()
    assert {n for n in entry_point.queries() if not corpus(n)} == {n for n in entry_point.oracle_sql() if not corpus(n)}


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, engine, name):
    df = entry_point.queries()[name](spark, FOLDER)
    relation = engine.sql(entry_point.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    got = in_order([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    want = in_order([tuple(plain(r[i]) for i in places) for r in relation.fetchall()])
    assert got == want
