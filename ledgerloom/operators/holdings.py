"""Holdings, allocation and summaries of every account at a point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify as C
from ledgerloom.functions.stats import pct_of_positive
from ledgerloom.operators.asof import always_one, clip, daily_prices, latest_prices, usd_units
from ledgerloom.operators.cash import account_sums, cash_balances


def quotes_for(prices: DataFrame, as_of, until=None) -> DataFrame:
    """(ticker, price) at one date, or the daily calendar when accounts have their own dates."""
    if isinstance(as_of, DataFrame):
        return daily_prices(prices, until).select("ticker", "date", "price")
    return latest_prices(prices, as_of).select("ticker", "price")


def add_kind(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    types = metadata.select(F.col("ticker").alias("asset"), "quote_type")
    return (
        rows.join(types, "asset", "left")
        .withColumn("asset_kind", C.asset_kind(F.col("asset"), F.col("quote_type")))
        .drop("quote_type")
    )


def valued(ledger: DataFrame, prices: DataFrame, as_of, until=None) -> DataFrame:
    """Positions and cash of every account with their dollar value; a missing price or rate counts as 0."""
    clipped = clip(C.classified(ledger), as_of)
    quotes = quotes_for(prices, as_of, until)
    on = ("date",) if "date" in quotes.columns else ()
    units = usd_units(quotes, on).withColumnRenamed("ticker", "instrument")
    if on:
        units = units.withColumnRenamed("date", "as_of")
    keys = ["instrument", "as_of"] if on else ["instrument"]
    name = F.col("instrument")
    is_cash = F.col("kind") == "cash"
    unit = F.when(is_cash & always_one(name), F.lit(1.0)).otherwise(F.coalesce("unit_usd", F.lit(0.0)))
    return account_sums(clipped).join(units.select(*keys, "unit_usd"), keys, "left").select(
        "account", "as_of", name.alias("asset"), "asset_type",
        F.col("quantity").alias("net_quantity"), (F.col("quantity") * unit).alias("value_usd"),
    )


def allocation(ledger: DataFrame, prices: DataFrame, metadata: DataFrame, as_of, until=None) -> DataFrame:
    """Share of every holding and cash key in its account.  The window sees one account's holdings."""
    total = F.sum("value_usd").over(Window.partitionBy("account", "as_of"))
    rows = valued(ledger, prices, as_of, until).withColumn("portfolio_total", total)
    return add_kind(rows, metadata).where("value_usd <> 0").select(
        "account", "as_of", "asset", "asset_type", "asset_kind", "net_quantity", "value_usd",
        pct_of_positive(F.col("value_usd"), F.col("portfolio_total")).alias("allocation_pct"),
    )


def portfolio_value(ledger: DataFrame, prices: DataFrame, as_of, until=None) -> DataFrame:
    return (
        valued(ledger, prices, as_of, until)
        .groupBy("account", "as_of")
        .agg(F.sum("value_usd").alias("portfolio_value"))
    )


def current_holdings(ledger: DataFrame) -> DataFrame:
    """Net quantity of every asset over the whole ledger, trades and cash alike."""
    return (
        ledger.groupBy("account", "asset")
        .agg(
            F.sum(C.signed_holding(F.col("action"), F.col("quantity"), 1)).alias("net_quantity"),
            F.sum(C.signed_holding(F.col("action"), F.col("quantity"), -1)).alias("presence"),
        )
        .where("presence <> 0")
        .drop("presence")
    )


def holdings_with_value(ledger: DataFrame, prices: DataFrame, metadata: DataFrame, as_of) -> DataFrame:
    """Whole-ledger holdings at the last price in listing currency; the bare quantity where there is none."""
    quotes = latest_prices(prices, as_of).select(F.col("ticker").alias("asset"), "price")
    rows = current_holdings(ledger).join(quotes, "asset", "left").select(
        "account", "asset", "net_quantity",
        F.coalesce(F.col("net_quantity") * F.col("price"), F.col("net_quantity")).alias("market_value_usd"),
    )
    return add_kind(rows, metadata)


def holdings_allocation(ledger: DataFrame, prices: DataFrame, as_of) -> DataFrame:
    """Whole-ledger holdings in dollars with their share; unpriced holdings drop out."""
    units = usd_units(latest_prices(prices, as_of)).select(F.col("ticker").alias("asset"), "unit_usd")
    asset = F.col("asset")
    value = F.when(C.asset_type(asset).isin("cash_base", "cash_stable"), F.col("net_quantity")).otherwise(
        F.col("net_quantity") * F.col("unit_usd")
    )
    rows = current_holdings(ledger).join(units, "asset", "left").withColumn("value_usd", value)
    total = F.sum("value_usd").over(Window.partitionBy("account"))
    return rows.withColumn("total", total).where("value_usd <> 0").select(
        "account", "asset", "net_quantity", "value_usd",
        pct_of_positive(F.col("value_usd"), F.col("total")).alias("allocation_pct"),
    )


def holdings_summary(ledger: DataFrame, prices: DataFrame, as_of) -> DataFrame:
    """Whole-ledger counts and totals per account."""
    counts = current_holdings(ledger).groupBy("account").agg(F.count("asset").alias("holding_count"))
    money = cash_balances(C.classified(ledger)).groupBy("account").agg(F.sum("balance").alias("total_cash_usd"))
    value = (
        holdings_allocation(ledger, prices, as_of)
        .groupBy("account")
        .agg(F.sum("value_usd").alias("portfolio_value_usd"))
    )
    rows = ledger.groupBy("account").agg(
        F.max("date").alias("last_transaction_date"), F.count(F.lit(1)).alias("transaction_count")
    )
    return rows.join(counts, "account", "left").join(money, "account", "left").join(value, "account", "left").select(
        "account", F.coalesce("holding_count", F.lit(0)).alias("holding_count"), "total_cash_usd",
        "portfolio_value_usd", "last_transaction_date", "transaction_count",
    )


def summary(ledger: DataFrame, prices: DataFrame, as_of) -> DataFrame:
    """Holding count, cash, value and ledger size per account at a date."""
    clipped = clip(C.classified(ledger), as_of)
    per_asset = clipped.groupBy("account", "asset").agg(
        F.sum(C.signed_holding(F.col("action"), F.col("quantity"), -1)).alias("net"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("rows"),
    )
    counts = per_asset.groupBy("account").agg(
        F.count_if(F.col("net") != 0).alias("holding_count"),
        F.max("last_date").alias("last_transaction_date"),
        F.sum("rows").alias("transaction_count"),
    )
    cash_like = F.col("asset_type").isin("cash_base", "cash_fx", "cash_stable")
    worth = (
        valued(ledger, prices, as_of)
        .groupBy("account")
        .agg(
            F.sum(F.when(cash_like, F.col("value_usd")).otherwise(0.0)).alias("total_cash_usd"),
            F.sum("value_usd").alias("portfolio_value_usd"),
        )
    )
    zero = F.lit(0.0)
    return counts.join(worth, "account", "left").select(
        "account", "holding_count",
        F.coalesce("total_cash_usd", zero).alias("total_cash_usd"),
        F.coalesce("portfolio_value_usd", zero).alias("portfolio_value_usd"),
        "last_transaction_date", "transaction_count",
        F.lit(str(as_of)).cast("date").alias("as_of_date"),
    )
