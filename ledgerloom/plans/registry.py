"""Named queries: every operator applied to the ledger derived from one data folder.

Figures that depend on the order of addition or on the platform's exp and log are rounded; money sums are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions import classify as C
from ledgerloom.operators import (
    asof,
    cash,
    changes,
    correlation,
    exposure,
    fifo,
    holdings,
    indicators,
    irr,
    performance,
    quality,
    returns,
    risk,
    rules,
    scenarios,
    snapshot,
    splits,
    status,
)
from ledgerloom.session import checkpoint_folder
from ledgerloom.sources import readers, sinks
from ledgerloom.sources.store import LedgerStore
from ledgerloom.streaming import recalc, ticks

AS_OF = "2001-11-30"
TODAY = "2001-12-05"
EARLY = "1995-03-31"
BENCHMARK = "SPY"
TRACKED = "SPYM"

TARGETS = {"EURUSD=X": 40.0, "SPYM": 25.0, "SCHD": 15.0, "BTC-USD": 10.0, "VGIT": 10.0}
SAVING = [
    {"scenario": "steady", "monthly_contribution": 1000.0, "projection_years": 10, "inflation_rate": 0.0},
    {"scenario": "fixed", "monthly_contribution": 500.0, "annual_return_rate": 0.07, "projection_years": 20,
     "inflation_rate": 0.03},
    {"scenario": "goal", "monthly_contribution": 20000.0, "annual_return_rate": 0.06, "target_value": 2.0e7,
     "projection_years": 10, "inflation_rate": 0.02},
    {"scenario": "small-goal", "monthly_contribution": 100.0, "target_value": 6.0e6, "projection_years": 5,
     "inflation_rate": 0.0},
]
SPENDING = [
    {"scenario": "default", "inflation_rate": 3.0, "time_horizon_years": 30},
    {"scenario": "rich", "inflation_rate": 2.0, "time_horizon_years": 25, "expected_return": 0.06,
     "withdrawal_rate": 9.0},
    {"scenario": "fixed", "inflation_rate": 0.0, "time_horizon_years": 10, "expected_return": 0.0,
     "annual_withdrawal": 600000.0},
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[LedgerStore], DataFrame]) -> Callable[[LedgerStore], DataFrame]:
    """Registers a query over the ledger store under the function's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(LedgerStore.open(spark, folder))

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def seven_digits(df: DataFrame, *names: str) -> DataFrame:
    """Seven significant digits, for figures without a natural scale."""
    return df.withColumns({n: F.col(n).cast("float").cast("double") for n in names})


def rounded_doubles(df: DataFrame, digits: int) -> DataFrame:
    return rounded(df, digits, *[n for n, t in df.dtypes if t == "double"])


# --- scans, sources, sinks -------------------------------------------------------------------------------------

@query
def ledger_page(s):
    cols = ("account", "id", "date", "asset", "action", "quantity", "price", "currency", "fees")
    return readers.page(s.txn.select(*cols), ["date", "id"], 50, 100, "1996-01-01", "1999-12-31")


@query
def ledger_page_total(s):
    return readers.page_total(s.txn, "1996-01-01", "1999-12-31")


@query
def report_page(s):
    return readers.page(s.daily(AS_OF), ["date", "account"], 30, 60, start="1998-01-01")


@query
def price_upsert(s):
    trades = s.views.trade_lines.select(F.col("asset").alias("ticker"), "date", "price", F.col("id").alias("seq"))
    return sinks.merge_prices(s.prices, trades)


@query
def metadata_upsert(s):
    best = F.max_by("sector", F.struct("parts", "sector"))
    profile = s.views.sector_parts.groupBy("ticker").agg(best.alias("sector"))
    incoming = profile.select("ticker", "sector", F.lit("scan").alias("source"), F.lit("Global").alias("region"))
    merged = sinks.merge_metadata(
        s.metadata.select("ticker", "quote_type", "sector", "region", "source"), incoming, ("sector", "region", "source")
    )
    return merged.select("ticker", "quote_type", "sector", "region", "source")


@query
def chart_bars(s):
    third, seventh = F.col("volume") % 3 == 0, F.col("volume") % 7 == 0
    chart = s.bars.withColumns(
        {
            "open": F.when(~third, F.col("open")),
            "high": F.when(~third, F.col("high")),
            "close": F.when(~seventh, F.col("close")),
        }
    )
    return readers.chart_to_bars(chart, AS_OF)


@query
def price_rows(s):
    return readers.price_rows(s.prices.withColumnRenamed("price", "close"), "1996-01-01", AS_OF)


@query
def cash_prices(s):
    return readers.cash_prices(s.txn.select(F.col("asset").alias("ticker")).distinct(), "2001-01-01", AS_OF)


@query
def latest_indicator(s):
    """A monthly indicator written and read back as a CSV file with blanks."""
    path = f"{checkpoint_folder(s.spark)}/indicator-{uuid.uuid4().hex}"
    text = F.coalesce(F.col("unrate").cast("string"), F.lit(" "))
    s.macro.select(F.col("date").cast("string").alias("observation_date"), text.alias("UNRATE")).write.mode(
        "overwrite"
    ).option("header", True).csv(path)
    return readers.latest_value(readers.read_indicator(s.spark, path, "observation_date", "UNRATE"))


@query
def purged_prices(s):
    wrong = s.prices.where("ticker = 'EURUSD=X'").withColumn("ticker", F.lit("USD"))
    return sinks.purge_bad_prices(s.prices.unionByName(wrong)).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("price").alias("price_sum")
    )


# --- classification --------------------------------------------------------------------------------------------

def _names(s):
    seen = s.txn.select("asset", "currency", "fee_currency").distinct()
    return seen.select(F.explode(F.array("asset", "currency", "fee_currency")).alias("asset")).where(
        "asset <> ''"
    ).distinct()


@query
def asset_classes(s):
    a = F.col("asset")
    rows = _names(s).withColumn("asset_type", C.asset_type(a))
    t = F.col("asset_type")
    return rows.select(
        a, t, C.is_stablecoin(a).alias("stablecoin"), C.is_cash_like(a, t).alias("cash_like"),
        C.normalize_cash_asset(a, t).alias("normalized"), C.cash_key(a, t).alias("cash_key"),
        C.cash_display_currency(C.cash_key(a, t)).alias("display_currency"),
        C.quote_currency_pair(t).alias("quote_pair"), C.fee_ticker(a, t).alias("fee_ticker"),
        C.is_fetchable(a).alias("fetchable"),
    )


@query
def asset_kinds(s):
    q, t = F.col("quote_type"), F.col("ticker")
    return s.metadata.select(
        t, C.asset_kind(t, q).alias("asset_kind"), C.quote_kind(q).alias("quote_kind"),
        C.analysis_type(q).alias("analysis_type"), C.annualisation_periods(C.analysis_type(q)).alias("periods"),
        C.tracking_index(t).alias("tracking_index"),
    )


@query
def static_profiles(s):
    p = C.static_profile(F.col("asset"))
    kind = C.asset_kind(F.col("asset"), F.lit(None).cast("string"))
    return _names(s).withColumn("p", p).select(
        "asset", F.col("p.sector").alias("sector"), F.col("p.region").alias("region"),
        C.fallback_sector(F.col("asset"), kind).alias("fallback_sector"),
        F.size(F.coalesce(C.fallback_sector_weights(F.col("asset")), F.array())).alias("fallback_weights"),
    )


@query
def trading_days(s):
    d = F.col("date")
    iso, old = F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd-MM-yyyy")
    return s.txn.select("date").distinct().select(
        d, C.last_trading_day(d).alias("trading_day"), C.parse_day(iso).alias("from_iso"),
        C.parse_day(old).alias("from_old"), C.parse_day(F.concat(iso, F.lit("x"))).alias("from_bad"),
    )


@query
def signed_quantities(s):
    a, q = F.col("action"), F.col("quantity")
    return s.txn.groupBy("account", "action").agg(
        F.sum(C.signed_holding(a, q, 1)).alias("exchange_added"),
        F.sum(C.signed_holding(a, q, -1)).alias("exchange_subtracted"),
        F.sum(C.position_delta(a, q)).alias("position"),
    )


@query
def quote_spreads(s):
    sp = C.spread(F.col("low"), F.col("high"))
    return s.bars.withColumn("s", sp).select(
        "ticker", "date", F.col("s.spread").alias("spread"), F.round("s.spread_pct", 8).alias("spread_pct")
    )


# --- validation ------------------------------------------------------------------------------------------------

@query
def row_validation(s):
    rows = quality.validate_rows(s.txn)
    return rows.select("action", F.explode("errors").alias("error")).groupBy("action", "error").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query
def accepted_rows(s):
    return quality.accepted(quality.validate_rows(s.txn)).groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


@query
def oversold_sales(s):
    return quality.oversold(s.txn)


@query
def unpriced_holdings(s):
    return quality.unpriced_holdings(s.txn, s.prices, EARLY)


# --- as-of look-ups --------------------------------------------------------------------------------------------

@query
def prices_asof(s):
    currency = F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD"))
    probes = s.txn.select(
        F.when(currency == "USD", F.col("asset")).otherwise(F.concat(currency, F.lit("USD=X"))).alias("ticker"),
        "date",
    ).distinct()
    recent = asof.price_asof(probes, s.prices, "2001-12-31", max_age_days=1).withColumnRenamed("price", "recent_price")
    return asof.price_asof(recent, s.prices, "2001-12-31")


@query
def market_values(s):
    rows = s.txn.where("action IN ('BUY', 'SELL')").select("account", "id", "asset", "quantity", "date")
    return asof.market_value_usd(rows, s.prices, "2001-12-31").select("account", "id", "asset", "value_usd")


@query
def cash_values(s):
    rows = s.txn.where("price IS NULL AND action <> 'SPLIT'").select("account", "id", "asset", "quantity", "date")
    return asof.cash_to_usd(rows, s.prices, "2001-12-31").select("account", "id", "asset", "usd_value")


# --- holdings --------------------------------------------------------------------------------------------------

def _clipped(s, as_of=AS_OF):
    return asof.clip(C.classified(s.txn), as_of)


def _allocation(s):
    return holdings.allocation(s.txn, s.prices, s.metadata, AS_OF)


def _cash(s):
    return cash.cash(_clipped(s), asof.latest_prices(s.prices, AS_OF))


@query
def current_holdings(s):
    return holdings.current_holdings(s.txn)


@query
def cash_balances(s):
    return cash.cash_balances(C.classified(s.txn))


@query
def holdings_with_value(s):
    return holdings.holdings_with_value(s.txn, s.prices, s.metadata, AS_OF)


@query
def holdings_allocation(s):
    return rounded(holdings.holdings_allocation(s.txn, s.prices, AS_OF), 8, "allocation_pct")


@query
def holdings_summary(s):
    return holdings.holdings_summary(s.txn, s.prices, AS_OF)


@query
def cash_report(s):
    return _cash(s).drop("as_of")


@query
def split_positions(s):
    return splits.positions(_clipped(s)).drop("as_of")


@query
def allocation(s):
    return rounded(_allocation(s).drop("as_of"), 8, "allocation_pct")


@query
def portfolio_value(s):
    return holdings.portfolio_value(s.txn, s.prices, AS_OF).drop("as_of")


@query
def summary(s):
    return holdings.summary(s.txn, s.prices, AS_OF)


# --- lots, status, income --------------------------------------------------------------------------------------

@query
def realized_gains(s):
    return fifo.realized_gains(s.txn, s.prices, AS_OF)


@query
def realized_gains_asset(s):
    return fifo.realized_gains(s.txn, s.prices, AS_OF, from_date="1999-01-01", asset="aapl")


@query
def realized_gains_by_year(s):
    rows = fifo.realized_gains_by_year(fifo.realized_gains(s.txn, s.prices, AS_OF))
    return rounded(rows, 4, "total_realized_gain", "short_term_gain", "long_term_gain")


@query
def fifo_metrics(s):
    rows = fifo.fifo_metrics(s.txn, s.prices, AS_OF).drop("as_of")
    return rounded(rows, 2, "unrealized_gain", "total_profit")


def _status(s):
    return status.status(s.txn, s.prices, AS_OF)


@query
def account_status(s):
    return rounded(_status(s), 2, "unrealized_gain", "total_profit").withColumn(
        "total_gain_pct", F.round("total_gain_pct", 8)
    )


@query
def income(s):
    return status.income(s.txn, s.prices, AS_OF)


@query
def income_since(s):
    return status.income(s.txn, s.prices, AS_OF, from_date="1998-01-01", asset="usd")


@query
def income_totals(s):
    return status.income_totals(status.income(s.txn, s.prices, AS_OF))


# --- returns ---------------------------------------------------------------------------------------------------

@query
def daily_returns(s):
    rows = returns.daily_returns(s.txn, s.prices, AS_OF, "zero")
    return rounded(rows, 8, "portfolio_daily_return", "investment_return")


@query
def guarded_returns(s):
    """Daily returns that end before an account's first day without a price."""
    rows = returns.daily_returns(s.txn, s.prices, AS_OF)
    return rounded(rows, 8, "portfolio_daily_return", "investment_return")


@query
def unpriced_days(s):
    return returns.unpriced_days(s.txn, s.prices, AS_OF)


def _performance(s):
    return performance.performance(s.daily(AS_OF), s.prices, AS_OF, BENCHMARK)


@query
def performance_report(s):
    return rounded_doubles(_performance(s), 6)


@query
def performance_since(s):
    return rounded_doubles(
        performance.performance(s.daily(AS_OF), s.prices, AS_OF, BENCHMARK, from_date="1999-01-01"), 6
    )


@query
def period_returns(s):
    return rounded(returns.period_returns(s.daily(AS_OF), AS_OF), 6, "return_pct")


@query
def rolling_returns(s):
    return rounded(returns.rolling_returns(s.daily(AS_OF), AS_OF, 12), 6, "return_pct")


@query
def monthly_performance(s):
    rows = performance.monthly_performance(s.daily(AS_OF), AS_OF)
    # Growth of a few days scaled to a year can be huge.
    rows = seven_digits(rows, "time_weighted_return_pct", "cagr", "sharpe_ratio")
    return rounded(rows, 6, "max_drawdown")


@query
def cash_drag(s):
    rows = performance.cash_drag(holdings.summary(s.txn, s.prices, AS_OF), _performance(s), AS_OF)
    return rounded(
        rows, 4, "cash_pct", "portfolio_cagr", "benchmark_cagr", "drag_vs_portfolio_cagr", "drag_vs_benchmark",
        "drag_vs_portfolio_pct", "drag_vs_benchmark_pct",
    )


@query
def decomposition(s):
    rows = status.decomposition(s.txn, s.prices, s.daily(AS_OF), AS_OF)
    return rounded(
        rows, 2, "total_growth_pct", "from_contributions_pct", "from_returns_usd", "from_returns_pct", "total_gain"
    )


@query
def money_weighted_return(s):
    values = holdings.portfolio_value(s.txn, s.prices, AS_OF)
    return rounded(irr.money_weighted_return(s.txn, s.prices, values, AS_OF), 6, "mwr")


@query
def asset_irr(s):
    """Internal rate per asset over all accounts: buys out, sales in, the position's value at the end."""
    trades = _clipped(s).where("action IN ('BUY', 'SELL')").select(
        "asset", "date",
        F.when(F.col("action") == "BUY", -F.col("quantity") * F.col("price")).otherwise(
            F.col("quantity") * F.col("price")
        ).alias("amount"),
    )
    held = splits.positions(_clipped(s)).groupBy("asset").agg(F.sum("net_quantity").alias("q"))
    last = asof.latest_prices(s.prices, AS_OF).select(F.col("ticker").alias("asset"), "price")
    final = held.join(last, "asset").select(
        "asset", asof.day(AS_OF).alias("date"), (F.col("q") * F.col("price")).alias("amount")
    )
    return rounded(irr.xirr(trades.unionByName(final), ["asset"]), 6, "irr")


@query
def widget(s):
    rows = returns.widget(s.daily(AS_OF), _status(s), AS_OF, 30)
    points = F.aggregate("series", F.lit(0.0), lambda acc, p: acc + p["value"])
    return rows.select(
        "account", "as_of_date", "last_refresh", "value", "today_amount", F.round("today_pct", 8).alias("today_pct"),
        "total_amount", F.round("total_pct", 8).alias("total_pct"), F.size("series").alias("points"),
        points.alias("series_sum"), F.col("series")[0]["date"].alias("series_from"),
    )


# --- exposure --------------------------------------------------------------------------------------------------

@query
def currency_exposure(s):
    return rounded(exposure.currency_exposure(_allocation(s), _cash(s), AS_OF), 8, "pct")


@query
def concentration(s):
    return rounded(exposure.concentration(_allocation(s)), 6, "hhi")


@query
def top_holdings(s):
    return rounded(exposure.top_holdings(_allocation(s)), 8, "allocation_pct")


@query
def largest_holdings(s):
    return rounded(exposure.largest_holdings(_allocation(s), 20), 8, "allocation_pct")


@query
def kind_exposure(s):
    return rounded(exposure.kind_exposure(_allocation(s)), 6, "allocation_pct")


@query
def holdings_table(s):
    return rounded(exposure.holdings_table(_allocation(s)), 8, "allocation_pct")


@query
def sector_exposure(s):
    rows = exposure.sector_exposure(exposure.add_sectors(_allocation(s), s.metadata))
    return rounded(rounded(rows, 2, "value_usd"), 4, "pct")


@query
def rebalance(s):
    return exposure.rebalance(_allocation(s), TARGETS)


@query
def day_change(s):
    return rounded(exposure.day_change(_allocation(s), s.prices, AS_OF), 6, "day_gain_usd")


@query
def correlation_matrix(s):
    return rounded(correlation.correlation_matrix(s.txn, s.prices, AS_OF, 12), 6, "correlation")


@query
def diversification(s):
    return rounded_doubles(correlation.diversification(_allocation(s), s.prices, AS_OF, 252, 0.05), 6)


# --- scenarios -------------------------------------------------------------------------------------------------

def _values(s):
    now = s.daily(AS_OF).where(F.col("date") == asof.day(AS_OF)).select("account", "portfolio_value")
    return now.join(_performance(s).select("account", "cagr"), "account", "left")


@query
def projection(s):
    rows = scenarios.projection(_values(s), SAVING)
    large = ("projected_value_nominal", "projected_value_real", "projected_goal_value", "return_portion")
    return seven_digits(rounded(rows, 4, "annual_return_rate", "years_to_goal", "required_return_rate"), *large)


@query
def projection_path(s):
    return scenarios.projection_path(_values(s), 24, 750.0, 7.0)


@query
def accumulation(s):
    rows = scenarios.accumulation(_values(s), 36, 100.0, -2.0)
    total = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v)
    return rows.select(
        "account", F.size("values").alias("points"), F.round(total, 2).alias("values_sum"), "projected_value",
        "total_contributions", "gain_from_returns",
    )


@query
def goal_months(s):
    return rounded(
        scenarios.goal_months(_values(s), F.col("portfolio_value") * 1.5, 2000.0, 6.0, inflation_rate=0.01), 2, "target"
    )


@query
def goal_bound(s):
    return rounded(
        scenarios.goal_months(_values(s), F.col("portfolio_value") * 1.25, 30000.0, -3.0, max_months=240), 2, "target"
    )


@query
def withdrawal(s):
    rows = scenarios.withdrawal(_values(s), SPENDING)
    return seven_digits(rows, *[n for n, t in rows.dtypes if t == "double"])


# --- ledger changes --------------------------------------------------------------------------------------------

@query
def exchange_legs(s):
    requests = s.views.cash_orders.where("action = 'WITHDRAW'").select(
        "account", "id", "date", F.col("asset").alias("from_asset"), F.lit("EUR").alias("to_asset"),
        (F.col("total") / 8.0).alias("quantity"), F.lit(0.5).alias("rate"),
    )
    return changes.exchange_legs(requests)


def _batch(s):
    """Edits double fees-bearing income, deletes remove exchanges of one year, one split is added per account."""
    edits = s.txn.where("action = 'DIVIDEND' AND year(date) = 1999").select(
        "account", "id", (F.col("quantity") * 2).alias("quantity"), F.date_sub("date", 3).alias("date")
    )
    deletes = s.txn.where("action = 'EXCHANGE_FROM' AND year(date) = 2000").select("account", "id")
    splits_wanted = s.txn.groupBy("account").agg(F.max("id").alias("id"), F.max("date").alias("date")).select(
        "account", (F.col("id") + 700).alias("id"), "date", F.lit(" spym ").alias("asset"), F.lit(3.0).alias("ratio")
    )
    return changes.apply_changes(s.txn, edits, deletes, changes.split_rows(splits_wanted))


@query
def changed_ledger(s):
    after, _ = _batch(s)
    return after.groupBy("account", "action").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity"), F.max("date").alias("last_date")
    )


@query
def recalc_from(s):
    _, since = _batch(s)
    return since


# --- bars ------------------------------------------------------------------------------------------------------

def _bars(s):
    return asof_bars(s.bars)


def asof_bars(bars):
    return bars.where(F.col("date") <= asof.day(AS_OF))


def _types(s):
    return s.metadata.select("ticker", C.analysis_type(F.col("quote_type")).alias("type"))


@query
def ticker_returns(s):
    return rounded(risk.returns(_bars(s)), 10, "ret")


@query
def rsi(s):
    return rounded(indicators.rsi(_bars(s)), 8, "rsi")


@query
def rsi_series(s):
    return rounded(indicators.rsi_series(_bars(s)), 6, "rsi")


@query
def moving_averages(s):
    return rounded(
        indicators.moving_averages(_bars(s)), 8, "price_vs_ma50", "price_vs_ma200", "ma50_vs_ma200"
    )


@query
def macd(s):
    return rounded_doubles(indicators.macd(_bars(s)), 8)


@query
def williams_r(s):
    return rounded_doubles(indicators.williams_r(_bars(s)), 8)


@query
def stochastic(s):
    return rounded_doubles(indicators.stochastic(_bars(s)), 8)


@query
def stochastic_rsi(s):
    return rounded_doubles(indicators.stochastic_rsi(_bars(s)), 8)


@query
def return_risk(s):
    window = risk.between_days(s.bars, AS_OF, risk.LOOKBACK_DAYS)
    return rounded_doubles(risk.return_risk(risk.returns(window), risk.with_periods(window, _types(s))), 6)


@query
def drawdowns(s):
    return rounded(risk.drawdowns(_bars(s)), 8, "max_drawdown", "ulcer_index")


@query
def trailing_cagr(s):
    rows = s.bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars")).select("ticker")
    for years in (1, 3, 5):
        rows = rows.join(risk.cagr(_bars(s), years), "ticker", "left")
    return rounded_doubles(rows.join(risk.calmar(_bars(s)), "ticker", "left"), 8)


@query
def bar_count_cagr(s):
    return rounded(risk.bar_count_cagr(_bars(s), 2.0), 8, "cagr")


@query
def benchmark_risk(s):
    rets = risk.returns(_bars(s))
    rows = risk.benchmark_risk(risk.aligned_returns(rets, risk.constant_benchmark(_bars(s), BENCHMARK)))
    return rounded_doubles(rows, 6)


@query
def tracking_error(s):
    bars = _bars(s)
    aligned = risk.aligned_returns(risk.returns(bars), risk.constant_benchmark(bars, TRACKED))
    return rounded(risk.tracking_error(aligned, risk.with_periods(bars, _types(s))), 8, "tracking_error")


def _navs(s):
    return asof.latest_prices(s.prices, AS_OF).select("ticker", F.col("price").alias("nav"))


@query
def year_range(s):
    return rounded_doubles(risk.year_range(s.bars, _navs(s), AS_OF), 8)


@query
def asset_metrics(s):
    # The indices of the tracking table are not among the bars; funds stand in for them.
    own = C.tracking_index(F.col("ticker")) != vocab.DEFAULT_INDEX
    index = F.when(own | (F.col("quote_type") == "ETF"), F.lit(BENCHMARK)).otherwise(F.lit(TRACKED))
    tracking = s.metadata.select("ticker", index.alias("index"))
    rows = risk.asset_metrics(s.bars, _types(s), tracking, AS_OF, BENCHMARK, nav=_navs(s))
    return rounded_doubles(rows.withColumn("warnings", F.array_join("warnings", ",")), 6)


@query
def technicals(s):
    rows = indicators.technicals(_bars(s))
    return rounded(rows, 8, *[n for n, t in rows.dtypes if t == "double" and n not in ("ma50", "ma200")])


# --- price coverage --------------------------------------------------------------------------------------------

@query
def required_tickers(s):
    return quality.required_tickers(s.txn)


@query
def last_bucket_dates(s):
    return quality.last_bucket_dates(s.prices, AS_OF)


@query
def required_checkpoints(s):
    return quality.required_checkpoints(s.txn, s.prices, AS_OF)


def _missing(s, end=AS_OF):
    return quality.missing_checkpoints(quality.required_checkpoints(s.txn, s.prices, end), s.prices)


@query
def missing_checkpoints(s):
    return _missing(s)


@query
def coverage_issues(s):
    return quality.coverage_issues(_missing(s))


@query
def stale_tickers(s):
    return quality.stale_tickers(quality.required_tickers(s.txn), s.prices, "2001-11-20", 17)


@query
def missing_or_stale(s):
    return quality.missing_or_stale(quality.required_tickers(s.txn), s.prices, TODAY, 1)


@query
def price_report(s):
    return quality.price_report(s.txn, s.prices, TODAY, 3)


@query
def repair_summary(s):
    return quality.repair_summary(s.txn, s.prices, TODAY, 3)


@query
def verify_prices(s):
    return quality.verify_prices(s.txn, s.prices, TODAY, 5)


@query
def freshness(s):
    return quality.freshness(s.txn, s.prices, TODAY, 2)


@query
def unhealthy_tickers(s):
    return quality.unhealthy_tickers(s.txn, s.prices, TODAY, 3)


@query
def data_quality_summary(s):
    return quality.data_quality_summary(s.txn, s.prices, TODAY, 3)


@query
def repair_plan(s):
    return quality.repair_plan(s.txn, s.prices, TODAY, 3)


@query
def metadata_cache(s):
    rows = quality.metadata_cache(s.metadata, AS_OF, 5)
    return rows.withColumn("sector_weights", F.size(F.coalesce("sector_weights", F.array())))


# --- rules -----------------------------------------------------------------------------------------------------

@query
def macro_regime(s):
    return rules.macro_regime(s.macro, s.bars, BENCHMARK)


@query
def month_shares(s):
    return rounded(rules.month_shares(s.txn, s.prices, AS_OF), 8, "idle_share")


@query
def buy_filters(s):
    return rounded(rules.buy_filters(_bars(s), rules.BuyPlan()), 6, "rsi")


@query
def buy_map(s):
    plan = rules.BuyPlan()
    rows = rules.buy_map(
        rules.month_shares(s.txn, s.prices, AS_OF),
        rules.macro_regime(s.macro, s.bars, BENCHMARK),
        rules.buy_filters(_bars(s), plan),
        plan,
        rules.underperformance(s.daily(AS_OF), s.prices, AS_OF, BENCHMARK),
    )
    dollars = ("bonus_usd", "carried_usd", "buy_usd", "deferred_usd", "base_usd")
    return rounded(rounded(rows, 6, "idle_share", "rsi"), 4, *dollars)


@query
def underperformance(s):
    return rounded(
        rules.underperformance(s.daily(AS_OF), s.prices, AS_OF, BENCHMARK), 6, "return_pct", "benchmark_pct",
        "shortfall_pct",
    )


# --- documents -------------------------------------------------------------------------------------------------

@query
def publish_snapshot(s):
    """Fields read back from each account's document."""
    quoted = s.prices.where(F.col("date") <= asof.day(AS_OF)).agg(F.max("date").alias("prices_as_of"))
    docs = snapshot.publish_snapshot(
        holdings.summary(s.txn, s.prices, AS_OF), _status(s), s.daily(AS_OF), quoted, AS_OF
    )
    schema = (
        "portfolio_value_usd double, today struct<abs double, pct double>, total struct<abs double, pct double>, "
        "history array<struct<date date, value double>>, prices_as_of date, as_of_date date"
    )
    return docs.withColumn("d", F.from_json("document", schema)).select(
        "account", F.col("d.portfolio_value_usd").alias("portfolio_value_usd"), F.col("d.today.abs").alias("today_abs"),
        F.col("d.total.abs").alias("total_abs"), F.size("d.history").alias("history_points"),
        F.col("d.prices_as_of").alias("prices_as_of"), F.col("d.as_of_date").alias("as_of_date"),
    )


@query
def dashboard_snapshot(s):
    """Counts and totals read back from each account's full document."""
    docs = snapshot.dashboard_snapshot(
        holdings.summary(s.txn, s.prices, AS_OF), _status(s), _allocation(s).drop("as_of"), _cash(s).drop("as_of"),
        _performance(s), s.daily(AS_OF), AS_OF,
    )
    schema = (
        "summary struct<holding_count bigint, portfolio_value_usd double>, "
        "allocation_rows array<struct<asset string, value_usd double>>, cash_rows array<struct<cash_key string>>, "
        "performance struct<total_days int>, history array<struct<date date, value double>>"
    )
    value = F.aggregate("d.allocation_rows", F.lit(0.0), lambda acc, r: acc + r["value_usd"])
    return docs.withColumn("d", F.from_json("document", schema)).select(
        "account", F.col("d.summary.holding_count").alias("holding_count"), value.alias("allocation_usd"),
        F.size("d.allocation_rows").alias("allocation_rows"), F.size("d.cash_rows").alias("cash_rows"),
        F.col("d.performance.total_days").alias("total_days"), F.size("d.history").alias("history_points"),
    )


@query
def sector_weight_items(s):
    """Sector weights stored as JSON text, each list with items of wrong types among them."""
    bad = '{"sector": 5, "weight": 0.5}, {"sector": "Energy", "weight": "0.5"}, {"weight": 1}, {"sector": "Energy"}, null, 7, "x"'
    text = F.regexp_replace(F.to_json("sector_weights"), r"\]$", f", {bad}]")
    parsed = s.metadata.where(F.size("sector_weights") > 0).select("ticker", C.sector_weights_of(text).alias("items"))
    return parsed.select("ticker", F.inline("items"))


def _scratch(s, name: str) -> str:
    return f"{checkpoint_folder(s.spark)}/{name}-{uuid.uuid4().hex}"


# --- streams ---------------------------------------------------------------------------------------------------

def _ticks(events):
    return events.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")


@query
def tick_closes(s):
    """Price table that the event stream fills, the open day included, over the files available."""
    folder = _scratch(s, "ticks")
    schema = s.views.table("events").schema
    events = s.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(s.views.folder)
    sinks.write_prices(f"{folder}/prices", s.prices.where("false"))
    ticks.stream_closes_into_prices(_ticks(events), f"{folder}/prices", f"{folder}/state").awaitTermination()
    return sinks.read_price_table(s.spark, f"{folder}/prices").select("ticker", F.col("date").alias("day"), "price")


@query
def hourly_closes(s):
    rows = ticks.closes(_ticks(s.views.table("events")), every="1 hour")
    return rows.select("ticker", F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "price", "ticks")


EARLY_TICKS = "ts < TIMESTAMP '2024-01-20 00:00:00' AND event_id % 10 <> 0"
LATE_ROWS = "action = 'TAX' AND date >= DATE '2001-03-01'"


@query
def streamed_hours(s):
    """Hourly closes and late ticks after two arrivals: nine of ten ticks up to a day, then all others."""
    folder, ticked = _scratch(s, "hours"), _ticks(s.views.table("events"))
    table, early = ticks.CloseTable(s.spark, f"{folder}/table"), F.expr(EARLY_TICKS)
    for arrived in (ticked.where(early), ticked.where(~early)):
        arrived.write.mode("append").parquet(f"{folder}/ticks")
        stream = s.spark.readStream.schema(arrived.schema).parquet(f"{folder}/ticks")
        ticks.stream_hourly_closes(stream, table, f"{folder}/state").awaitTermination()
    hour = F.date_format("window_start", "yyyy-MM-dd HH").alias("hour")
    late = table.late().groupBy("ticker", hour).agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.count(F.lit(1)).alias("ticks"))
    return table.closes().select("ticker", hour, "price", "ticks", F.lit(False).alias("late")).unionByName(late.withColumn("late", F.lit(True)))


@query
def resumed_returns(s):
    """The returns table after late ledger rows came in as a stream and were derived from the stored month ends on."""
    folder = _scratch(s, "returns")
    table = recalc.ReturnsTable(s.spark, f"{folder}/table", 8)
    table.build(s.txn.where(f"NOT ({LATE_ROWS})"), s.prices, AS_OF, "zero")
    s.txn.where(LATE_ROWS).select("account", "date").write.parquet(f"{folder}/changes")
    changes = s.spark.readStream.schema("account string, date date").parquet(f"{folder}/changes")
    recalc.stream_recalculation(changes, lambda: s.txn, s.prices, table, f"{folder}/state", AS_OF, "zero").awaitTermination()
    return rounded(table.days(), 8, "portfolio_daily_return", "investment_return")


@query
def dated_copies(s):
    """Rows copied, and rows there, of two days' copies of prices and metadata; the second run of a day copies nothing."""
    folder, tables = _scratch(s, "copies"), {"prices": s.prices, "metadata": s.metadata, "bars": s.bars}
    rows = []
    for stamp, content in (("20010630", tables), ("20010630", tables), ("20010805", {n: t.limit(0) for n, t in tables.items()} | {"prices": s.prices.where("ticker = 'SPY'")})):
        copied = sinks.dated_copies(content, folder, stamp)
        rows += [(stamp, name, len(rows) // 3 + 1, n, sinks.read_dated_copy(tables[name], folder, name, stamp).count()) for name, n in copied.items()]
    return s.spark.createDataFrame(rows, "stamp string, name string, run int, rows_copied long, rows_there long")


@query
def stored_documents(s):
    """Fields of the short documents, read back from the document table after a second write of some accounts."""
    path = _scratch(s, "documents")
    quoted = s.prices.where(F.col("date") <= asof.day(AS_OF)).agg(F.max("date").alias("prices_as_of"))
    docs = snapshot.publish_snapshot(holdings.summary(s.txn, s.prices, AS_OF), _status(s), s.daily(AS_OF), quoted, AS_OF)
    sinks.write_documents(docs, path, 4)
    ends = F.col("account").endswith("1")
    sinks.write_documents(sinks.document_table(s.spark, path).read().where(ends).withColumn("document", F.lit("{}")), path, 4)
    read = sinks.document_table(s.spark, path).read().withColumn("d", F.from_json("document", "portfolio_value_usd double, as_of_date date"))
    return read.select("account", F.col("d.portfolio_value_usd").alias("portfolio_value_usd"), F.col("d.as_of_date").alias("as_of_date"))


@query
def recalculated_returns(s):
    changed = s.txn.where(LATE_ROWS).select("account", "date")
    rows = recalc.rederive(s.txn, s.prices, changed, AS_OF, "zero")
    return rounded(rows, 8, "portfolio_daily_return", "investment_return")


