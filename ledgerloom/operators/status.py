"""Account status, growth decomposition and income."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import classify as C
from ledgerloom.functions.stats import ratio
from ledgerloom.operators.asof import add_rate, clip, daily_rates
from ledgerloom.operators.fifo import HOT_ROWS, fifo_metrics
from ledgerloom.operators.holdings import portfolio_value

FLOW_OF_ACTION = {
    "DEPOSIT": "deposits",
    "WITHDRAW": "withdrawals",
    "DIVIDEND": "income",
    "INTEREST": "income",
    "FEE": "fees",
    "TAX": "taxes",
}


def usd_flows(clipped: DataFrame, prices: DataFrame, until) -> DataFrame:
    """Row counts and dates, and deposits, withdrawals, income, fees and taxes in dollars of each row's own date.

    Rows are folded per (account, flow, name, date) before names are classified and rates joined, so the join sees days, not rows.
    """
    flow = F.create_map(*[F.lit(x) for item in FLOW_OF_ACTION.items() for x in item])
    booked = F.try_element_at(flow, F.col("action"))

    def leg(kind, what, name, amount):
        return F.struct(
            what.alias("flow"), F.lit(kind).alias("leg"), name.alias("name"), amount.alias("amount")
        )

    no_name = F.lit(None).cast("string")
    fee_name = C.fee_currency_or_default(F.col("fee_currency"), F.col("currency"))
    row = leg("row", F.lit("rows"), no_name, F.lit(1.0))
    own = leg("own", booked, F.col("asset"), F.col("quantity"))
    fee = leg("fee", F.lit("fees"), fee_name, F.col("fees"))
    is_booked, has_fee = F.col("action").isin(*FLOW_OF_ACTION), F.coalesce(F.col("fees") > 0, F.lit(False))
    legs = (
        F.when(is_booked & has_fee, F.array(row, own, fee))
        .when(is_booked, F.array(row, own))
        .when(has_fee, F.array(row, fee))
        .otherwise(F.array(row))
    )
    per_day = (
        clipped.select("account", "as_of", "date", F.inline(legs))
        .groupBy("account", "as_of", "flow", "leg", "name", "date")
        .agg(F.sum("amount").alias("amount"))
    )
    name, bucket = F.col("name"), F.col("bucket")
    per_day = per_day.withColumn("bucket", C.asset_type(name))
    key = F.when(F.col("leg") == "fee", C.fee_ticker(name, bucket)).when(
        F.col("leg") == "own", C.normalize_cash_asset(name, bucket)
    )
    rated = add_rate(per_day.withColumn("key", key), "key", daily_rates(prices, until))
    names = sorted(set(FLOW_OF_ACTION.values()))
    usd = F.col("amount") * F.col("rate")
    return rated.groupBy("account", "as_of").agg(
        F.sum(F.when(F.col("leg") == "row", F.col("amount"))).cast("long").alias("transactions_count"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        *[F.coalesce(F.sum(F.when(F.col("flow") == n, usd)), F.lit(0.0)).alias(n) for n in names]
    )


def status(ledger: DataFrame, prices: DataFrame, as_of, until=None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ledger counts, dollar flows, value, gains and lot figures per account."""
    last_day = until if isinstance(as_of, DataFrame) else as_of
    clipped = clip(C.classified(ledger), as_of)
    keys = ["account", "as_of"]
    joined = (
        usd_flows(clipped, prices, last_day)
        .join(portfolio_value(ledger, prices, as_of, until), keys, "left")
        .join(fifo_metrics(ledger, prices, as_of, until, hot_rows), keys, "left")
        .na.fill(0.0)
    )
    invested = F.col("deposits") - F.col("withdrawals")
    gain = F.when(invested > 0, F.col("portfolio_value") - invested)
    return joined.select(
        "account", "transactions_count", "start_date", "end_date", "portfolio_value",
        invested.alias("total_invested"), "deposits", "withdrawals", "income", "fees", "taxes",
        gain.alias("total_gain"),
        (F.when(invested > 0, F.try_divide(F.col("portfolio_value") - invested, invested)) * 100.0).alias(
            "total_gain_pct"
        ),
        "cost_basis", "realized_gain", "unrealized_gain", "total_profit",
        F.col("as_of").alias("as_of_date"),
    )


def decomposition(
    ledger: DataFrame, prices: DataFrame, daily: DataFrame, as_of, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Growth since the first daily row, split into contributions and returns."""
    first = daily.groupBy("account").agg(
        F.min("date").alias("as_of"), F.min_by("portfolio_value", "date").alias("initial_value")
    )
    start = status(ledger, prices, first, until=as_of, hot_rows=hot_rows).alias("s")
    end = status(ledger, prices, as_of, hot_rows=hot_rows).alias("e")

    def change(name):
        return F.col(f"e.{name}") - F.col(f"s.{name}")

    pieces = (
        end.join(start, "account")
        .join(first.select("account", "initial_value"), "account")
        .select(
            "account",
            F.col("e.as_of_date").alias("as_of_date"),
            F.col("e.portfolio_value").alias("current_value"),
            F.coalesce("initial_value", F.lit(0.0)).alias("initial_value"),
            (change("deposits") - change("withdrawals")).alias("net_deposits"),
            (change("realized_gain") + change("unrealized_gain")).alias("total_gain"),
            change("income").alias("total_income"),
            (change("fees") + change("taxes")).alias("total_fees_and_taxes"),
        )
    )
    growth = F.col("current_value") - F.col("initial_value")
    return pieces.select(
        "account", "as_of_date",
        growth.alias("total_growth_usd"),
        F.when(F.col("initial_value") > 0, F.try_divide(growth, F.col("initial_value")) * 100.0)
        .otherwise(0.0)
        .alias("total_growth_pct"),
        F.col("net_deposits").alias("from_contributions_usd"),
        (ratio(F.col("net_deposits"), growth) * 100.0).alias("from_contributions_pct"),
        F.col("total_gain").alias("from_returns_usd"),
        (ratio(F.col("total_gain"), growth) * 100.0).alias("from_returns_pct"),
        "initial_value", "current_value", "net_deposits", "total_gain", "total_income", "total_fees_and_taxes",
    )


def income(ledger: DataFrame, prices: DataFrame, as_of, from_date=None, asset: str | None = None) -> DataFrame:
    """Dividends and interest per asset, action and ledger currency, in dollars of each row's own date."""
    rows = clip(C.classified(ledger.where(F.col("action").isin("DIVIDEND", "INTEREST"))), as_of)
    if from_date is not None:
        rows = rows.where(F.col("date") >= F.lit(str(from_date)).cast("date"))
    if asset is not None:
        rows = rows.where(F.upper("asset") == asset.upper())
    per_day = (
        rows.groupBy("account", "asset", "asset_type", "action", "currency", "date")
        .agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
        .withColumn("key", C.normalize_cash_asset(F.col("asset"), F.col("asset_type")))
    )
    rated = add_rate(per_day, "key", daily_rates(prices, as_of))
    return (
        rated.groupBy("account", "asset", "action", "currency")
        .agg(
            F.sum("quantity").alias("total_quantity"),
            F.sum(F.col("quantity") * F.col("rate")).alias("usd_value"),
            F.sum("n").alias("transaction_count"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
        .withColumn("currency", F.coalesce("currency", F.lit("USD")))
    )


def income_totals(rows: DataFrame) -> DataFrame:
    usd = F.col("usd_value")
    return rows.groupBy("account").agg(
        F.sum(usd).alias("total_income_usd"),
        F.sum(F.when(F.col("action") == "DIVIDEND", usd).otherwise(0.0)).alias("total_dividends_usd"),
        F.sum(F.when(F.col("action") == "INTEREST", usd).otherwise(0.0)).alias("total_interest_usd"),
    )
