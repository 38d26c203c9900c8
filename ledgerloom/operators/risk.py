"""Risk figures per ticker over daily bars (sample statistics), and their comparison with a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.classify import annualisation_periods
from ledgerloom.functions.stats import annualised, compound
from ledgerloom.operators.asof import day
from ledgerloom.vocab import TINY

RISK_FREE = 0.0425
LOOKBACK_DAYS = 366
HISTORY_DAYS = 365 * 5 + 14
LEAST_ALIGNED = 10
LEAST_RETAINED = 0.6


def by_day():
    return Window.partitionBy("ticker").orderBy("date")


def between_days(bars: DataFrame, as_of, days: int) -> DataFrame:
    return bars.where(F.col("date").between(F.date_sub(day(as_of), days), day(as_of)))


def returns(bars: DataFrame) -> DataFrame:
    """Simple return of each bar on the close before; bars after a close of zero or less are left out."""
    before = F.lag("close").over(by_day())
    return bars.select("ticker", "date", "close", before.alias("before")).where("before > 0").select(
        "ticker", "date", (F.try_divide("close", "before") - 1.0).alias("ret")
    )


def with_periods(bars: DataFrame, types: DataFrame) -> DataFrame:
    """(ticker, periods): trading days per year by asset type, 252 where unknown."""
    tickers = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"))
    kind = F.coalesce("type", F.lit("UNKNOWN"))
    return tickers.join(types.select("ticker", "type"), "ticker", "left").select(
        "ticker", "bars", kind.alias("type"), annualisation_periods(kind).alias("periods")
    )


def _nonzero(x: Column) -> Column:
    return F.abs(x) >= TINY


def return_risk(rets: DataFrame, periods: DataFrame, risk_free: float = RISK_FREE) -> DataFrame:
    """Volatility, Sharpe and Sortino ratio, downside deviation, skewness and kurtosis."""
    p, r, n = F.col("periods"), F.col("ret"), F.col("n")
    below = r - (F.pow(F.lit(1.0 + risk_free), F.try_divide(F.lit(1.0), p)) - 1.0)
    agg = (
        rets.join(periods.select("ticker", "periods"), "ticker")
        .groupBy("ticker", "periods")
        .agg(
            F.count(r).cast("double").alias("n"),
            F.stddev_samp(r).alias("std"),
            F.stddev_pop(r).alias("std_pop"),
            compound(r).alias("total"),
            F.sum(F.pow(F.least(below, F.lit(0.0)), 2)).alias("below_sq"),
            F.skewness(r).alias("skew"),
            F.kurtosis(r).alias("kurt"),
        )
    )
    vol = F.col("std") * F.sqrt(p)
    annual = annualised(F.col("total"), n / p)
    down = F.when(n >= 2, F.sqrt(F.col("below_sq") / n) * F.sqrt(p))
    spread_out = F.col("std_pop") >= TINY
    skew = F.when((n >= 3) & spread_out, F.try_divide(n * n, (n - 1) * (n - 2)) * F.col("skew"))
    kurt = F.when(
        (n >= 4) & spread_out,
        F.try_divide(n * (n + 1), (n - 1) * (n - 2) * (n - 3)) * n * (F.col("kurt") + 3.0)
        - F.try_divide(3.0 * F.pow(n - 1, 2), (n - 2) * (n - 3)),
    )
    return agg.select(
        "ticker",
        F.when(n >= 2, vol).alias("annual_volatility"),
        F.when((n >= 2) & _nonzero(vol), F.try_divide(annual - risk_free, vol)).alias("sharpe_ratio"),
        F.when((n >= 2) & _nonzero(down), F.try_divide(annual - risk_free, down)).alias("sortino_ratio"),
        down.alias("downside_deviation"),
        skew.alias("skewness"),
        kurt.alias("kurtosis"),
    )


def drawdowns(bars: DataFrame) -> DataFrame:
    """Deepest fall from a peak (negative), its first date, and the root mean square fall in percent."""
    upto = by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = bars.withColumn("peak", F.max("close").over(upto))
    rows = rows.withColumn("dd", F.when(_nonzero(F.col("peak")), F.try_divide(F.col("close") - F.col("peak"), "peak")))
    deepest = F.min(F.struct("dd", "date"))
    return (
        rows.groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("n"),
            deepest.alias("low"),
            F.sqrt(F.sum(F.pow(F.col("dd") * 100.0, 2)) / F.count(F.lit(1))).alias("ulcer_index"),
        )
        .select(
            "ticker",
            F.when(F.col("n") >= 2, F.coalesce("low.dd", F.lit(0.0))).alias("max_drawdown"),
            F.when((F.col("n") >= 2) & (F.col("low.dd") < 0), F.col("low.date")).alias("max_drawdown_date"),
            F.when(F.col("n") >= 2, F.col("ulcer_index")).alias("ulcer_index"),
        )
    )


def shift_years(date: Column, years: Column) -> Column:
    """Same day ``years`` later; 29 February becomes 1 March where the year has none."""
    moved = F.add_months(date, years * 12)
    leap_day = (F.month(date) == 2) & (F.dayofmonth(date) == 29) & (F.dayofmonth(moved) == 28)
    return F.when(leap_day, F.date_add(moved, 1)).otherwise(moved)


def elapsed_years(start: Column, end: Column) -> Column:
    """Whole anniversaries plus the fraction of the year running at the end."""
    whole = F.year(end) - F.year(start)
    whole = F.when(shift_years(start, whole) > end, whole - 1).otherwise(whole)
    mark = shift_years(start, whole)
    span = F.datediff(shift_years(mark, F.lit(1)), mark)
    return F.when(end > start, whole + F.datediff(end, mark) / span)


def trailing_start(bars: DataFrame, years: int) -> DataFrame:
    """(ticker, start, end): last bar at or before the day ``years`` before the last bar; absent if none."""
    ends = bars.groupBy("ticker").agg(F.max("date").alias("end"))
    return (
        bars.join(ends, "ticker")
        .where((F.col("date") <= shift_years(F.col("end"), F.lit(-years))) & (F.col("date") < F.col("end")))
        .groupBy("ticker", "end")
        .agg(F.max("date").alias("start"))
    )


def trailing_bars(bars: DataFrame, years: int) -> DataFrame:
    window = trailing_start(bars, years)
    return bars.join(window, "ticker").where(F.col("date") >= F.col("start")).drop("start", "end")


def cagr(bars: DataFrame, years: int) -> DataFrame:
    """Growth per calendar year over the trailing window; NULL where the history is shorter."""
    name = f"cagr_{years}y"
    ends = trailing_bars(bars, years).groupBy("ticker").agg(
        F.min("date").alias("start"), F.max("date").alias("end"),
        F.min_by("close", "date").alias("first"), F.max_by("close", "date").alias("last"),
    )
    span = elapsed_years(F.col("start"), F.col("end"))
    grown = annualised(F.try_divide("last", "first") - 1.0, span)
    return ends.select(
        "ticker", F.when((F.col("first") > 0) & (F.col("last") > 0) & _nonzero(span), grown).alias(name)
    )


def bar_count_cagr(bars: DataFrame, years: float, periods: float = 252.0) -> DataFrame:
    """Growth over a number of bars instead of dates."""
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    rows = bars.withColumns({"k": F.row_number().over(newest) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("ticker"))})
    back = F.least(F.lit(int(periods * years)), F.col("n") - 1)
    picked = rows.groupBy("ticker").agg(
        F.max(F.when(F.col("k") == 0, F.col("close"))).alias("last"),
        F.max(F.when(F.col("k") == back, F.col("close"))).alias("first"),
        F.max(back).alias("back"),
    )
    return picked.select(
        "ticker",
        F.when(
            (F.col("back") >= 1) & (F.col("first") > 0),
            annualised(F.try_divide("last", "first") - 1.0, F.col("back") / periods),
        ).alias("cagr"),
    )


def calmar(bars: DataFrame, years: int = 3) -> DataFrame:
    """Trailing growth over the trailing drawdown."""
    fall = drawdowns(trailing_bars(bars, years)).select("ticker", "max_drawdown")
    depth = F.abs("max_drawdown")
    return cagr(bars, years).join(fall, "ticker").select(
        "ticker", F.when(depth >= TINY, F.try_divide(F.col(f"cagr_{years}y"), depth)).alias("calmar_ratio")
    )


def aligned_returns(rets: DataFrame, against: DataFrame) -> DataFrame:
    """Returns of each ticker and of its counterpart on common dates.

    ``against`` maps ticker to counterpart; the counterpart's returns are found by (counterpart, date).
    """
    other = rets.select(F.col("ticker").alias("counterpart"), "date", F.col("ret").alias("bench"))
    return rets.join(against, "ticker").join(other, ["counterpart", "date"]).select("ticker", "date", "ret", "bench")


def constant_benchmark(bars: DataFrame, benchmark: str) -> DataFrame:
    return bars.groupBy("ticker").agg(F.lit(benchmark).alias("counterpart"))


def _capture_labels(up: Column, down: Column) -> tuple[Column, Column]:
    return (
        F.when(up >= 100, "Outperforms").when(up >= 80, "Good").when(up >= 50, "Weak").when(up.isNotNull(), "Poor"),
        F.when(down <= 80, "Protects").when(down <= 100, "Average").when(down <= 120, "Weak").when(
            down.isNotNull(), "Poor"
        ),
    )


def benchmark_risk(aligned: DataFrame) -> DataFrame:
    """Beta, up and down capture over common dates; NULL below ten of them."""
    r, b = F.col("ret"), F.col("bench")
    agg = aligned.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_samp(r, b).alias("cov"),
        F.var_samp(b).alias("var"),
        *[
            compound(F.when(cond, col)).alias(f"{side}_{name}")
            for side, cond in (("up", b > 0), ("down", b < 0))
            for name, col in (("asset", r), ("bench", b))
        ],
    )
    enough = F.col("n") >= LEAST_ALIGNED

    def capture(side):
        bench = F.col(f"{side}_bench")
        return F.when(enough & (F.abs(bench) > TINY), F.try_divide(F.col(f"{side}_asset"), bench) * 100.0)

    rows = agg.select(
        "ticker", F.col("n").alias("aligned"),
        F.when(enough & _nonzero(F.col("var")), F.try_divide("cov", "var")).alias("beta"),
        capture("up").alias("up_capture"), capture("down").alias("down_capture"),
    )
    up, down = _capture_labels(F.col("up_capture"), F.col("down_capture"))
    return rows.withColumns({"up_capture_ratio": up, "down_capture_ratio": down})


def tracking_error(aligned: DataFrame, periods: DataFrame) -> DataFrame:
    agg = aligned.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("tracked"), F.stddev_samp(F.col("ret") - F.col("bench")).alias("std")
    )
    return agg.join(periods.select("ticker", "periods"), "ticker").select(
        "ticker", "tracked",
        F.when(F.col("tracked") >= LEAST_ALIGNED, F.col("std") * F.sqrt("periods")).alias("tracking_error"),
    )


def premium_discount(price: Column, nav: Column) -> Column:
    return F.when(_nonzero(nav), F.try_divide(price - nav, nav) * 100.0)


def range_place(price: Column, high: Column, low: Column) -> Column:
    """Place inside a high-low range and distance from the high, in percent."""
    width = high - low
    usable = _nonzero(width) & _nonzero(high)
    return F.struct(
        F.when(usable, F.try_divide(price - low, width) * 100.0).alias("range_percent"),
        F.when(usable, F.try_divide(high - price, high) * 100.0).alias("from_high"),
    )


def year_range(bars: DataFrame, nav: DataFrame, as_of) -> DataFrame:
    """Last close against its 52-week range and against a net asset value per unit."""
    agg = between_days(bars, as_of, 364).groupBy("ticker").agg(
        F.max_by("close", "date").alias("price"), F.max("high").alias("high"), F.min("low").alias("low")
    )
    place = range_place(F.col("price"), F.col("high"), F.col("low"))
    return agg.join(nav, "ticker", "left").withColumn("place", place).select(
        "ticker", premium_discount(F.col("price"), F.col("nav")).alias("premium_discount"),
        F.col("place.range_percent").alias("fifty_two_week_range_percent"),
        F.col("place.from_high").alias("fifty_two_week_percent_from_high"),
    )


def asset_metrics(
    bars: DataFrame, types: DataFrame, tracking: DataFrame, as_of, benchmark: str,
    lookback_days: int = LOOKBACK_DAYS, risk_free: float = RISK_FREE, nav: DataFrame | None = None,
) -> DataFrame:
    """The risk table of every ticker with its data warnings.

    ``types`` maps ticker to asset type, ``tracking`` ticker to the index its tracking error is measured against,
    ``nav`` (ticker, nav) to its net asset value per unit; without one there is no premium or discount.
    """
    window = between_days(bars, as_of, lookback_days)
    history = between_days(bars, as_of, max(lookback_days, HISTORY_DAYS))
    rets = returns(window)
    periods = with_periods(window, types)
    bench = benchmark_risk(aligned_returns(rets, constant_benchmark(window, benchmark)))
    track = tracking_error(aligned_returns(rets, tracking.withColumnRenamed("index", "counterpart")), periods)
    span = history.groupBy("ticker").agg(
        (F.datediff(F.max("date"), F.min("date")) / 365.2425).alias("history_years")
    )
    out = periods.join(tracking, "ticker", "left")
    parts = [return_risk(rets, periods, risk_free), drawdowns(window), span, bench, track, calmar(history)]
    parts += [cagr(history, y) for y in (1, 3, 5)]
    nav = types.select("ticker", F.lit(None).cast("double").alias("nav")) if nav is None else nav
    parts.append(year_range(bars, nav, as_of))
    for part in parts:
        out = out.join(part, "ticker", "left")

    observations = F.greatest(F.col("bars") - 1, F.lit(0))

    def retained(n):
        return F.coalesce(F.try_divide(F.coalesce(n, F.lit(0)).cast("double"), observations), F.lit(0.0))

    def warn(cond, code):
        return F.when(cond, F.lit(code))

    warnings = F.array_compact(
        F.array(
            warn(F.col("bars") < 50, "INSUFFICIENT_LOOKBACK_HISTORY"),
            warn(F.coalesce("history_years", F.lit(0.0)) < 1, "INSUFFICIENT_LONG_HISTORY"),
            F.when(F.col("aligned").isNull(), F.lit("BENCHMARK_METRICS_UNAVAILABLE")).when(
                retained(F.col("aligned")) < LEAST_RETAINED, F.lit("BENCHMARK_ALIGNMENT_REDUCED")
            ),
            F.when(F.col("tracked").isNull(), F.lit("TRACKING_ERROR_UNAVAILABLE")).when(
                retained(F.col("tracked")) < LEAST_RETAINED, F.lit("TRACKING_ALIGNMENT_REDUCED")
            ),
        )
    )
    return out.where("bars >= 2").select(
        "ticker", "type", "bars", "beta", "annual_volatility", "sharpe_ratio", "sortino_ratio", "downside_deviation",
        "max_drawdown", "max_drawdown_date", "cagr_1y", "cagr_3y", "cagr_5y", "calmar_ratio", "ulcer_index",
        "skewness", "kurtosis", "up_capture", "down_capture", "up_capture_ratio", "down_capture_ratio",
        "tracking_error", F.col("index").alias("tracking_error_benchmark"), "premium_discount",
        "fifty_two_week_range_percent", "fifty_two_week_percent_from_high", warnings.alias("warnings"),
    )
