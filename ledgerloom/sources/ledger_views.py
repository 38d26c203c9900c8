"""The ledger model read off the supplied star-schema tables.

Orders become cash rows, line items become trades, and both give prices and rates.  The text of each view is
plain ANSI SQL, so the same mapping can be run by any engine that checks the results.

Quantities, prices and rates are multiples of powers of two, so money sums are exact in any order of addition.
A trade's id is its place inside its order; that window sees one order's lines at a time.  Ids of one order: cash
row +0, lines from +1, a split 512 above its line, the second exchange leg +1000.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

ACCOUNTS = 32
FX_CURRENCIES = ("EUR", "GBP", "UAH", "JPY", "CHF", "CAD", "AUD", "HKD", "SGD")
FX_BASE = {
    "EUR": 1120, "GBP": 1300, "UAH": 28, "JPY": 8, "CHF": 1060, "CAD": 760, "AUD": 690, "HKD": 131, "SGD": 740,
}
TICKERS = (
    "SPY", "AAPL", "SCHD", "XLU", "SGOV", "SPYM", "SAP.DE", "VOD.L",
    "SONY.T", "NESN.SW", "SHOP.TO", "BHP.AX", "TCEH.HK", "DBSX.SG", "BTC-USD", "ETH-USD",
)
NATIVE = (
    "USD", "USD", "USD", "USD", "USD", "USD", "EUR", "GBP",
    "JPY", "CHF", "CAD", "AUD", "HKD", "SGD", "USD", "USD",
)
# Tickers that are spread over sectors; the others have one sector or none.
WEIGHTED = ("SPY", "SCHD", "VOD.L", "NESN.SW")
CASH_NAMES = (
    "USD", "USD", "USD", "USD", "EUR", "GBP", "EURUSD=X", "CASH GBP", "JPYUSD=X", "USDC", "CASH USDT", "CASH UAH",
)


def _pick(key: str, values) -> str:
    """CASE that maps 0..n-1 to the given literals."""
    arms = " ".join(
        f"WHEN {i} THEN {v if isinstance(v, (int, float)) else repr(v)}" for i, v in enumerate(values)
    )
    return f"CASE {key} {arms} END"


FEE_CURRENCY = f"""CASE l.l_linenumber WHEN 7 THEN 'BTC' WHEN 6 THEN 'EUR' WHEN 5 THEN NULL WHEN 4 THEN '' WHEN 3 THEN 'USDC'
    ELSE {_pick("l.l_partkey % 16", NATIVE)} END"""

TRADE_LINES = f"""
SELECT
  concat('A', lpad(CAST(o.o_custkey % {ACCOUNTS} AS STRING), 2, '0')) AS account,
  l.l_orderkey * 1024 + l.line AS id,
  CAST(l.l_shipdate AS DATE) AS date,
  {_pick("l.l_partkey % 16", TICKERS)} AS asset,
  CASE WHEN l.l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS action,
  l.l_quantity AS quantity,
  ((64 + 8 * (l.l_partkey % 16)) * 64
    + CAST(round(l.l_discount * 100) AS BIGINT) * 32
    - CAST(round(l.l_tax * 100) AS BIGINT) * 16
    + datediff('day', DATE '1995-01-01', CAST(l.l_shipdate AS DATE))) / 64.0E0 AS price,
  {_pick("l.l_partkey % 16", NATIVE)} AS currency,
  CASE WHEN l.l_tax > 0 THEN CAST(round(l.l_tax * 100) AS BIGINT) / 16.0E0 END AS fees,
  {FEE_CURRENCY} AS fee_currency
FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line
  FROM lineitem
) l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

# Every name that a line can bring into the ledger, its order not looked up.
TRADE_NAMES = f"""
SELECT DISTINCT {_pick("l.l_partkey % 16", TICKERS)} AS asset, {_pick("l.l_partkey % 16", NATIVE)} AS currency,
  {FEE_CURRENCY} AS fee_currency
FROM lineitem l
"""

CASH_ORDERS = f"""
SELECT
  concat('A', lpad(CAST(o_custkey % {ACCOUNTS} AS STRING), 2, '0')) AS account,
  o_orderkey * 1024 AS id,
  CAST(o_orderdate AS DATE) AS date,
  {_pick("o_custkey % 12", CASH_NAMES)} AS asset,
  CASE o_orderpriority
    WHEN '1-URGENT' THEN 'DEPOSIT'
    WHEN '2-HIGH' THEN 'DEPOSIT'
    WHEN '3-MEDIUM' THEN 'WITHDRAW'
    WHEN '4-NOT SPECIFIED' THEN {_pick("o_orderkey % 4", ("DIVIDEND", "INTEREST", "FEE", "TAX"))}
    ELSE {_pick("o_orderkey % 3", ("EXCHANGE", "TRANSFER", "INTEREST"))}
  END AS action,
  CAST(floor(o_totalprice) AS BIGINT) AS total,
  o_orderkey
FROM orders
"""

CASH_ROWS = """
SELECT account, id, date,
  CASE action WHEN 'EXCHANGE' THEN 'USD' ELSE asset END AS asset,
  CASE action WHEN 'EXCHANGE' THEN 'EXCHANGE_FROM' ELSE action END AS action,
  CASE action WHEN 'DEPOSIT' THEN total / 4.0E0 WHEN 'WITHDRAW' THEN total / 16.0E0
    WHEN 'EXCHANGE' THEN -(total / 64.0E0) ELSE total / 256.0E0 END AS quantity,
  CAST(NULL AS DOUBLE) AS price,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS STRING) WHEN action = 'EXCHANGE' THEN '' ELSE 'USD' END AS currency,
  CAST(NULL AS DOUBLE) AS fees,
  CAST(NULL AS STRING) AS fee_currency,
  CASE WHEN action = 'EXCHANGE' THEN CAST(o_orderkey AS STRING) END AS exchange_group_id
FROM cash_orders
UNION ALL
SELECT account, id + 1000, date, 'GBPUSD=X', 'EXCHANGE_TO', total / 64.0E0 * 0.75E0, CAST(NULL AS DOUBLE), '',
  CAST(NULL AS DOUBLE), CAST(NULL AS STRING), CAST(o_orderkey AS STRING)
FROM cash_orders WHERE action = 'EXCHANGE'
"""

SPLIT_ROWS = """
SELECT account, min(id) + 512 AS id, min(date) AS date, asset, 'SPLIT' AS action,
  CASE asset WHEN 'AAPL' THEN 2.0E0 ELSE 0.5E0 END AS quantity
FROM trade_lines
WHERE asset IN ('AAPL', 'ETH-USD') AND year(date) IN (1997, 1999)
GROUP BY account, asset, year(date)
"""

TRANSACTIONS = """
SELECT account, id, date, asset, action, quantity, price, currency, fees, fee_currency,
  'X' || substr(account, 2, 1) AS exchange, CAST(NULL AS STRING) AS exchange_group_id
FROM trade_lines
UNION ALL
SELECT account, id, date, asset, action, quantity, price, currency, fees, fee_currency,
  'BANK' AS exchange, exchange_group_id
FROM cash_rows
UNION ALL
SELECT account, id, date, asset, action, quantity, CAST(NULL AS DOUBLE), CAST(NULL AS STRING), CAST(NULL AS DOUBLE),
  CAST(NULL AS STRING), '' AS exchange, CAST(NULL AS STRING)
FROM split_rows
"""

PRICES = f"""
SELECT asset AS ticker, date, floor(CAST(sum(CAST(price * 64 AS BIGINT)) AS DOUBLE) / count(*)) / 64.0E0 AS price
FROM trade_lines GROUP BY asset, date
UNION ALL
SELECT ticker, date, (base + floor(CAST(sum(noise) AS DOUBLE) / count(*))) / 1024.0E0 AS price
FROM (
  SELECT concat({_pick("o_orderkey % 9", FX_CURRENCIES)}, 'USD=X') AS ticker, CAST(o_orderdate AS DATE) AS date,
    {_pick("o_orderkey % 9", [FX_BASE[c] for c in FX_CURRENCIES])} AS base,
    CAST(floor(o_totalprice) AS BIGINT) % (1 + {_pick("o_orderkey % 9", [FX_BASE[c] // 8 for c in FX_CURRENCIES])}) AS noise
  FROM orders
) q
WHERE NOT (ticker = 'SGDUSD=X' AND date < DATE '1996-01-01')
GROUP BY ticker, date, base
"""

METADATA_FLAT = f"""
SELECT {_pick("asset_no", TICKERS)} AS ticker,
  CASE WHEN asset_no >= 14 THEN 'CRYPTOCURRENCY' WHEN asset_no IN (0, 2, 4) THEN 'ETF'
    WHEN asset_no IN (9, 10) THEN NULL WHEN asset_no = 11 THEN 'INDEX' ELSE 'EQUITY' END AS quote_type,
  {_pick("asset_no", NATIVE)} AS currency,
  asset_no, largest, parts
FROM (
  SELECT p_partkey % 16 AS asset_no, max(p_brand) AS largest, count(*) AS parts FROM part GROUP BY p_partkey % 16
) m
"""

SECTOR_PARTS = f"""
SELECT ticker, sector, count(*) AS parts
FROM (
  SELECT {_pick("p_partkey % 16", TICKERS)} AS ticker,
    CASE p_type WHEN 'STANDARD' THEN 'Technology' WHEN 'ECONOMY' THEN 'Healthcare' WHEN 'MEDIUM' THEN 'Energy'
      WHEN 'PROMO' THEN 'Bonds' WHEN 'LARGE' THEN 'Industrials' ELSE 'Utilities' END AS sector
  FROM part
) p
WHERE ticker IN ({", ".join(repr(t) for t in WEIGHTED)})
GROUP BY ticker, sector
"""

BARS = """
SELECT asset AS ticker, date,
  min_by(price, id) AS open, max(price) AS high, min(price) AS low, max_by(price, id) AS close,
  sum(quantity) AS volume
FROM trade_lines GROUP BY asset, date
"""

MACRO = """
SELECT last_day(CAST(o_orderdate AS DATE)) AS date,
  20.0E0 + sum(CAST(floor(o_totalprice) AS BIGINT)) % 200 / 10.0E0 AS cape,
  CASE WHEN count(*) % 11 = 0 THEN NULL ELSE sum(CAST(floor(o_totalprice) AS BIGINT)) % 101 * 1.0E0 END AS fear_greed,
  CASE WHEN count(*) % 13 = 0 THEN NULL ELSE 3.0E0 + sum(CAST(floor(o_totalprice) AS BIGINT)) % 30 / 10.0E0 END AS unrate
FROM orders GROUP BY last_day(CAST(o_orderdate AS DATE))
"""

# View name -> (text, views it reads).
VIEWS = {
    "trade_lines": (TRADE_LINES, ()),
    "trade_names": (TRADE_NAMES, ()),
    "cash_orders": (CASH_ORDERS, ()),
    "cash_rows": (CASH_ROWS, ("cash_orders",)),
    "split_rows": (SPLIT_ROWS, ("trade_lines",)),
    "txn": (TRANSACTIONS, ("trade_lines", "cash_rows", "split_rows")),
    "prices": (PRICES, ("trade_lines",)),
    "metadata_flat": (METADATA_FLAT, ()),
    "sector_parts": (SECTOR_PARTS, ()),
    "bars": (BARS, ("trade_lines",)),
    "macro": (MACRO, ()),
}


@dataclass
class LedgerViews:
    """Lazily built DataFrames of one data folder."""

    spark: SparkSession
    folder: str
    #: Keeps a view that several others read, given its name.
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _run(self, view: str, **given: DataFrame) -> DataFrame:
        text, needs = VIEWS[view]
        sources = {n: given[n] if n in given else getattr(self, n) for n in needs}
        for name in ("lineitem", "orders", "part"):
            if f"FROM {name}" in text or f"JOIN {name}" in text:
                sources[name] = self.table(name)
        for name in sources:
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
        text = text.replace("datediff('day',", "date_diff(DAY,")
        return self.spark.sql(text, **sources)

    trade_lines = cached_property(lambda self: self.keep(self._run("trade_lines"), "trade-lines"))
    trade_names = cached_property(lambda self: self._run("trade_names"))
    cash_orders = cached_property(lambda self: self._run("cash_orders"))
    cash_rows = cached_property(lambda self: self._run("cash_rows"))
    split_rows = cached_property(lambda self: self._run("split_rows"))
    txn = cached_property(lambda self: self._run("txn"))
    prices = cached_property(lambda self: self._run("prices"))

    def trade_txn(self, lines: DataFrame) -> DataFrame:
        """The transactions that the trade lines are."""
        return self._run("txn", trade_lines=lines, cash_rows=self.cash_rows.where("false"), split_rows=self._run("split_rows", trade_lines=lines).where("false"))

    def other_txn(self) -> DataFrame:
        """The transactions that the trade lines are not: cash rows and splits."""
        return self._run("txn", trade_lines=self.trade_lines.where("false"))

    metadata_flat = cached_property(lambda self: self._run("metadata_flat"))
    sector_parts = cached_property(lambda self: self._run("sector_parts"))
    bars = cached_property(lambda self: self._run("bars"))
    macro = cached_property(lambda self: self._run("macro"))

    @cached_property
    def metadata(self) -> DataFrame:
        """Asset metadata with sector weights as an array of (sector, share of parts)."""
        from pyspark.sql import functions as F

        weights = (
            self.sector_parts.withColumn("total", F.expr("sum(parts) OVER (PARTITION BY ticker)"))
            .groupBy("ticker")
            .agg(
                F.array_sort(
                    F.collect_list(
                        F.struct("sector", (F.col("parts") / F.col("total")).alias("weight"))
                    )
                ).alias("sector_weights")
            )
        )
        sector = F.when(F.col("asset_no").isin(1, 6, 8), F.lit("Technology")).when(
            F.col("asset_no").isin(12), F.lit("Energy")
        )
        return (
            self.metadata_flat.join(weights, "ticker", "left")
            .select(
                "ticker",
                "quote_type",
                F.concat(F.lit("Asset "), F.col("largest")).alias("long_name"),
                "currency",
                F.lit(None).cast("string").alias("asset_kind"),
                sector.alias("sector"),
                F.lit(None).cast("string").alias("industry"),
                F.lit(None).cast("string").alias("region"),
                "sector_weights",
                F.lit("parts").alias("source"),
                F.to_timestamp(F.date_sub(F.lit("2001-06-30").cast("date"), F.col("asset_no").cast("int"))).alias(
                    "fetched_at"
                ),
            )
        )


def ledger_views(spark: SparkSession, folder: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> LedgerViews:
    return LedgerViews(spark, folder, keep)


def view_ctes(*names: str) -> str:
    """The same views as a chain of common table expressions, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][1]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in order)
