"""Risk and benchmark statistics of daily account returns.

Windows and percentiles see one account's days.  The benchmark is one ticker's quotes, joined by date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import annualised, log_growth, ratio
from ledgerloom.operators.asof import day

YEAR = 365.25
ROOT_252 = 252.0**0.5


def _between(rows: DataFrame, as_of, from_date) -> DataFrame:
    rows = rows.where(F.col("date") <= day(as_of))
    return rows if from_date is None else rows.where(F.col("date") >= day(from_date))


def benchmark_returns(prices: DataFrame, benchmark: str, as_of, from_date=None) -> DataFrame:
    """Return of the benchmark on each of its quote dates since its quote before."""
    order = Window.partitionBy("ticker").orderBy("date")
    quotes = _between(prices.where(F.col("ticker") == benchmark), as_of, from_date)
    return (
        quotes.withColumn("before", F.lag("price").over(order))
        .where("before > 0")
        .select(
            F.col("ticker").alias("benchmark"), "date", "price",
            (F.try_divide(F.col("price") - F.col("before"), F.col("before")) * 100.0).alias("bench_ret"),
        )
    )


def _annual(growth, days):
    """Growth per year over a span of days; 0 where the span is empty."""
    return F.when(days > 0, annualised(growth, days / YEAR)).otherwise(F.lit(0.0))


def performance(
    daily: DataFrame, prices: DataFrame, as_of, benchmark: str = "SPY", from_date=None,
    risk_free_rate: float = 0.02, inflation_rate: float = 0.025,
) -> DataFrame:
    """36 figures per account: returns, risk, drawdowns, tail losses and benchmark comparison, most in percent."""
    rf, inflation = F.lit(risk_free_rate), F.lit(inflation_rate)
    target = risk_free_rate / 252.0 * 100.0
    ret = F.col("investment_return")
    order = Window.partitionBy("account").orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    bench = benchmark_returns(prices, benchmark, as_of, from_date)
    rows = _between(daily.where("portfolio_value > 0"), as_of, from_date)
    rows = rows.withColumn("peak", F.max("portfolio_value").over(upto)).withColumn(
        "drawdown", F.try_divide(F.col("peak") - F.col("portfolio_value"), F.col("peak")) * 100.0
    )
    rows = rows.withColumn("drawdown_before", F.lag("drawdown", 1, 0.0).over(order))
    rows = rows.join(bench.select("date", "bench_ret"), "date", "left")

    b = F.col("bench_ret")
    under = F.col("drawdown") > 0
    aligned = F.when(b.isNotNull(), ret)
    main = rows.groupBy("account").agg(
        F.count(F.lit(1)).cast("int").alias("total_days"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.min_by("portfolio_value", "date").alias("start_value"),
        F.max_by("portfolio_value", "date").alias("end_value"),
        F.avg("portfolio_daily_return").alias("avg_daily_return"),
        F.avg(ret).alias("avg_investment_return"),
        F.stddev_pop(ret).alias("std_dev"),
        F.percentile(ret, 0.05).alias("var_95"),
        F.percentile(ret, 0.01).alias("var_99"),
        (F.exp(F.sum(log_growth(ret / 100.0))) - 1.0).alias("twr"),
        F.coalesce(F.sqrt(F.avg(F.when(ret < target, F.pow(ret - target, 2)))), F.lit(0.0)).alias("downside"),
        F.max("drawdown").alias("max_drawdown"),
        F.coalesce(F.avg(F.when(under, F.col("drawdown"))), F.lit(0.0)).alias("avg_drawdown"),
        F.coalesce(
            ratio(F.count_if(under).cast("double"), F.count_if(under & (F.col("drawdown_before") == 0))), F.lit(0.0)
        ).alias("avg_drawdown_duration"),
        F.covar_pop(aligned, b).alias("cov"),
        F.var_pop(b).alias("var_mkt"),
        F.avg(ret - b).alias("avg_excess"),
        F.sqrt(F.avg(F.pow(ret - b, 2))).alias("te_daily"),
        F.sum(F.when(b > 0, ret)).alias("up_p"),
        F.sum(F.when(b > 0, b)).alias("up_b"),
        F.sum(F.when(b < 0, ret)).alias("down_p"),
        F.sum(F.when(b < 0, b)).alias("down_b"),
    )
    tails = (
        rows.select("account", ret)
        .join(main.select("account", "var_95", "var_99"), "account")
        .groupBy("account")
        .agg(
            F.avg(F.when(ret <= F.col("var_95"), ret)).alias("cvar_95"),
            F.avg(F.when(ret <= F.col("var_99"), ret)).alias("cvar_99"),
        )
    )
    months = (
        rows.groupBy("account", F.trunc("date", "month").alias("month"))
        .agg((F.exp(F.sum(log_growth(ret / 100.0))) - 1.0).alias("month_return"))
        .groupBy("account")
        .agg((F.percentile("month_return", 0.5) * 100.0).alias("median_monthly_return"))
    )
    bench_totals = bench.groupBy("benchmark").agg(
        F.min_by("price", "date").alias("bench_start"),
        F.max_by("price", "date").alias("bench_end"),
        (F.exp(F.sum(log_growth(F.col("bench_ret") / 100.0))) - 1.0).alias("bench_twr"),
    )
    joined = (
        main.join(tails, "account", "left")
        .join(months, "account", "left")
        .withColumn("benchmark", F.lit(benchmark))
        .join(bench_totals, "benchmark", "left")
    )

    days = F.datediff("end_date", "start_date").cast("double")
    bench_ok = (
        (F.coalesce("bench_start", F.lit(0.0)) > 0)
        & (F.coalesce("bench_end", F.lit(0.0)) > 0)
        & (F.coalesce("bench_twr", F.lit(-1.0)) > -1.0)
    )
    joined = joined.withColumns(
        {
            "days": days,
            "growth": _annual(F.col("twr"), days),
            "growth_floored": annualised(F.col("twr"), F.greatest(days / YEAR, F.lit(1.0 / YEAR))),
            "bench_growth": F.when(bench_ok, _annual(F.col("bench_twr"), days)).otherwise(0.0),
            "beta_raw": ratio(F.col("cov"), F.col("var_mkt")),
        }
    )
    zero = F.lit(0.0)
    beta = F.coalesce("beta_raw", zero)
    total_return = F.when(
        F.col("start_value") > 0,
        F.try_divide(F.col("end_value") - F.col("start_value"), F.col("start_value")) * 100.0,
    ).otherwise(0.0)
    vol = F.col("std_dev") * ROOT_252
    excess_growth = F.col("growth_floored") - rf
    out = {
        "total_gain": F.col("start_value") * F.col("twr"),
        "avg_daily_return": F.col("avg_daily_return"),
        "avg_investment_return": F.col("avg_investment_return"),
        "std_dev": F.col("std_dev"),
        "hist_volatility": vol,
        "var_95": F.col("var_95"),
        "var_99": F.col("var_99"),
        "cvar_95": F.coalesce("cvar_95", zero),
        "cvar_99": F.coalesce("cvar_99", zero),
        "max_drawdown": F.col("max_drawdown"),
        "avg_drawdown": F.col("avg_drawdown"),
        "avg_drawdown_duration": F.col("avg_drawdown_duration"),
        "time_weighted_return_pct": F.col("twr") * 100.0,
        "total_return_pct": total_return,
        "median_monthly_return": F.col("median_monthly_return"),
        "cagr": F.col("growth") * 100.0,
        "beta": beta,
        "sharpe_ratio": ratio(excess_growth, vol / 100.0, 0.0),
        "sortino_ratio": ratio(F.col("avg_investment_return") - target, F.col("downside"), 0.0) * ROOT_252,
        "treynor_ratio": ratio(excess_growth, beta, 0.0),
        "information_ratio": ratio(
            F.col("avg_excess") * 252.0 / 100.0, F.col("te_daily") * ROOT_252 / 100.0, 0.0
        ),
        "jensens_alpha": F.when(
            F.col("days") > 0, (F.col("growth") - (rf + beta * (F.col("bench_growth") - rf))) * 100.0
        ).otherwise(0.0),
        "relative_return": F.when(
            F.col("days") > 0, (F.col("growth") - F.col("bench_growth")) * 100.0
        ).otherwise(0.0),
        "tracking_error": F.coalesce(F.col("te_daily") * ROOT_252, zero),
        "spy_twr_pct": F.when(F.col("bench_twr") > -1.0, F.col("bench_twr") * 100.0).otherwise(0.0),
        "spy_cagr_pct": F.col("bench_growth") * 100.0,
        "up_capture_ratio": ratio(F.col("up_p"), F.col("up_b"), 0.0),
        "down_capture_ratio": ratio(F.col("down_p"), F.col("down_b"), 0.0),
        "calmar_ratio": ratio(F.col("growth") * 100.0, F.abs("max_drawdown"), 0.0),
        "real_cagr": ((1.0 + F.col("growth")) / (1.0 + inflation) - 1.0) * 100.0,
        "real_total_return_pct": (
            (1.0 + total_return / 100.0) / F.pow(1.0 + inflation, F.col("days") / YEAR) - 1.0
        )
        * 100.0,
    }
    return joined.select(
        "account", "total_days", "start_date", "end_date", "start_value", "end_value",
        *[column.alias(name) for name, column in out.items()],
    )


def monthly_performance(daily: DataFrame, as_of, risk_free_rate: float = 0.02) -> DataFrame:
    """Return to date, CAGR, Sharpe ratio and worst drawdown at every month end, from running windows alone."""
    ret = F.col("investment_return")
    order = Window.partitionBy("account").orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = daily.where((F.col("date") <= day(as_of)) & (F.col("portfolio_value") > 0))
    rows = rows.withColumn("peak", F.max("portfolio_value").over(upto)).withColumn(
        "drawdown", F.try_divide(F.col("peak") - F.col("portfolio_value"), F.col("peak")) * 100.0
    )
    rows = rows.select(
        "account", "date",
        F.min("date").over(upto).alias("start_date"),
        (F.exp(F.sum(log_growth(ret / 100.0)).over(upto)) - 1.0).alias("twr"),
        F.stddev_pop(ret).over(upto).alias("std_dev"),
        F.max("drawdown").over(upto).alias("max_drawdown"),
        F.coalesce(F.trunc(F.lead("date").over(order), "month") != F.trunc("date", "month"), F.lit(True)).alias(
            "month_end"
        ),
    ).where("month_end")
    days = F.datediff("date", "start_date").cast("double")
    floored = annualised(F.col("twr"), F.greatest(days / YEAR, F.lit(1.0 / YEAR)))
    return rows.select(
        "account", F.col("date").alias("month_end"),
        (F.col("twr") * 100.0).alias("time_weighted_return_pct"),
        (_annual(F.col("twr"), days) * 100.0).alias("cagr"),
        ratio(floored - risk_free_rate, F.col("std_dev") * ROOT_252 / 100.0, 0.0).alias("sharpe_ratio"),
        "max_drawdown",
    )


def cash_drag(
    summary: DataFrame, perf: DataFrame, as_of, benchmark_return_rate: float | None = None,
    cash_return_rate: float = 0.0,
) -> DataFrame:
    """Return forgone on idle cash against the account's own growth and the benchmark's."""
    own = F.coalesce("cagr", F.lit(0.0))
    bench = F.coalesce("spy_cagr_pct", F.lit(0.0))
    cash, value = F.col("total_cash_usd"), F.col("portfolio_value_usd")
    gap_own = own / 100.0 - cash_return_rate
    rate = F.lit(benchmark_return_rate) if benchmark_return_rate is not None else bench / 100.0
    gap_bench = rate - cash_return_rate

    def pct(part):
        return F.when(value > 0, F.try_divide(part, value) * 100.0).otherwise(0.0)

    return summary.join(
        perf.select("account", "cagr", "spy_cagr_pct", "start_date", "end_date"), "account", "left"
    ).select(
        "account",
        value.alias("total_portfolio_value"), cash.alias("total_cash_usd"), pct(cash).alias("cash_pct"),
        own.alias("portfolio_cagr"), bench.alias("benchmark_cagr"),
        F.lit(cash_return_rate).alias("assumed_cash_return_rate"),
        (cash * gap_own).alias("drag_vs_portfolio_cagr"), (cash * gap_bench).alias("drag_vs_benchmark"),
        pct(cash * gap_own).alias("drag_vs_portfolio_pct"), pct(cash * gap_bench).alias("drag_vs_benchmark_pct"),
        F.coalesce("start_date", day(as_of)).alias("period_start_date"),
        F.coalesce("end_date", day(as_of)).alias("period_end_date"),
    )
