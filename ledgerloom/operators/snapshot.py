"""One document per account: summary, status, allocation, cash, performance and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.asof import day
from ledgerloom.operators.returns import last_days

SHORT_HISTORY_DAYS = 180
LONG_HISTORY_DAYS = 365


def _nested(rows: DataFrame, name: str, first: str) -> DataFrame:
    """Rows of an account as one array of structs ordered by ``first`` (bounded: holdings, cash keys, days)."""
    cols = [c for c in rows.columns if c not in ("account", first)]
    return rows.groupBy("account").agg(F.array_sort(F.collect_list(F.struct(first, *cols))).alias(name))


def history(daily: DataFrame, as_of, days: int) -> DataFrame:
    rows = last_days(daily, as_of, days).select("account", "date", F.col("portfolio_value").alias("value"))
    return _nested(rows, "history", "date")


def _change_of_day(daily: DataFrame, as_of) -> DataFrame:
    two = last_days(daily, as_of, 2)

    def at(rank, name):
        return F.max(F.when(F.col("rank") == rank, F.col(name)))

    return two.groupBy("account").agg(
        F.struct(
            F.coalesce(at(1, "portfolio_value") - at(2, "portfolio_value"), F.lit(0.0)).alias("abs"),
            F.coalesce(at(1, "investment_return"), F.lit(0.0)).alias("pct"),
        ).alias("today")
    )


def _total(status: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return status.select(
        "account",
        F.struct(
            F.coalesce("total_gain", zero).alias("abs"), F.coalesce("total_gain_pct", zero).alias("pct")
        ).alias("total"),
    )


def publish_snapshot(summary: DataFrame, status: DataFrame, daily: DataFrame, prices_as_of: DataFrame, as_of) -> DataFrame:
    """Short document: value, change of the day, total gain and the last 180 days."""
    base = (
        summary.select("account", "portfolio_value_usd", "as_of_date")
        .join(_change_of_day(daily, as_of), "account", "left")
        .join(_total(status), "account", "left")
        .join(history(daily, as_of, SHORT_HISTORY_DAYS), "account", "left")
        .withColumn("_day", day(as_of))
        .join(prices_as_of.select(day(as_of).alias("_day"), "prices_as_of"), "_day", "left")
    )
    fields = ("portfolio_value_usd", "today", "total", "history", "prices_as_of", "as_of_date")
    return base.select("account", F.to_json(F.struct(*fields)).alias("document"))


def dashboard_snapshot(
    summary: DataFrame, status: DataFrame, allocation: DataFrame, cash: DataFrame, performance: DataFrame,
    daily: DataFrame, as_of,
) -> DataFrame:
    """Full document with every report of the account and a year of history."""

    def packed(rows, name):
        return rows.select("account", F.struct(*[c for c in rows.columns if c != "account"]).alias(name))

    parts = [
        packed(status, "status"),
        _nested(allocation, "allocation_rows", "asset"),
        _nested(cash, "cash_rows", "cash_key"),
        packed(performance, "performance"),
        _change_of_day(daily, as_of),
        _total(status),
        history(daily, as_of, LONG_HISTORY_DAYS),
    ]
    out = packed(summary, "summary")
    for part in parts:
        out = out.join(part, "account", "left")
    fields = [c for c in out.columns if c != "account"]
    return out.select("account", F.to_json(F.struct(*fields)).alias("document"))
