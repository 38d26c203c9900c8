"""Scans: paged ledger and report reads, chart and price rows, synthetic cash prices, indicator files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.operators.asof import day
from ledgerloom.schemas import PRICES, TRANSACTIONS


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Ledger table with the action in upper case, as every operator expects."""
    return spark.read.schema(TRANSACTIONS).parquet(path).withColumn("action", F.upper("action"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICES).parquet(path)


def date_range(rows: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("date") >= day(start))
    if end is not None:
        rows = rows.where(F.col("date") <= day(end))
    return rows


def page(rows: DataFrame, order: list[str], limit: int = 50, offset: int = 0, start=None, end=None) -> DataFrame:
    """One page of a dated table.  A limit right after the sort is a top-k; nothing is sorted as a whole."""
    return date_range(rows, start, end).orderBy(*order).offset(offset).limit(limit)


def page_total(rows: DataFrame, start=None, end=None) -> DataFrame:
    return date_range(rows, start, end).agg(F.count(F.lit(1)).alias("total"))


def chart_to_bars(chart: DataFrame, end) -> DataFrame:
    """Bars from chart rows: rows without a close are dropped, other gaps take the close."""
    fill = [F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")]
    return chart.where(F.col("close").isNotNull() & (F.col("date") <= day(end))).select(
        "ticker", "date", *fill, "close", "volume"
    )


def price_rows(quotes: DataFrame, start, end) -> DataFrame:
    """Prices from quote rows (ticker, date, close); pairs quoted the other way round are inverted."""
    close = F.col("close")
    inverted = F.when(F.col("ticker").isin(*vocab.REVERSE_QUOTED), F.try_divide(F.lit(1.0), close)).otherwise(close)
    return date_range(quotes, start, end).where(close.isNotNull()).select("ticker", "date", inverted.alias("price"))


def cash_prices(names: DataFrame, start, end) -> DataFrame:
    """Price 1 on every day of the range for each ``CASH ...`` name."""
    return names.where(F.col("ticker").startswith("CASH")).select(
        "ticker", F.explode(F.sequence(day(start), day(end))).alias("date"), F.lit(1.0).alias("price")
    )


def read_indicator(spark: SparkSession, path: str, date_column: str, value_column: str) -> DataFrame:
    """Dated values of an indicator file; columns are found by header name, blank values are dropped."""
    table = spark.read.option("header", True).csv(path)
    value = F.trim(F.col(f"`{value_column}`"))
    return table.where(value != "").select(
        F.trim(F.col(f"`{date_column}`")).cast("date").alias("date"), value.cast("double").alias("value")
    )


def latest_value(indicator: DataFrame) -> DataFrame:
    """Last non-blank value and its date."""
    return indicator.agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date"))
