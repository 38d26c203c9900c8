"""Technical indicators per ticker.

Fixed look-backs are windows over a ticker's bars.  Recursive averages (exponential and smoothed means) are prefix scans: a
step ``y -> (1 - a) y + a x`` is an affine map, and maps compose, so blocks of consecutive bars are summed side by side and
joined by one row a block.  A ticker with very many bars is smoothed in as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.vocab import TINY

BLOCK_BARS = 256


def by_day():
    return Window.partitionBy("ticker").orderBy("date")


def _last(n: int):
    return by_day().rowsBetween(-(n - 1), Window.currentRow)


def ordered(bars: DataFrame) -> DataFrame:
    """Bars with their position and the close before."""
    return bars.withColumns({"n": F.row_number().over(by_day()), "before": F.lag("close").over(by_day())})


def newest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_next", F.lead("date").over(by_day())).where("_next IS NULL").drop("_next")


def label(value: Column, steps: list[tuple[Column, str]], other: str) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for cond, text in steps:
        out = out.when(cond, F.lit(text))
    return out.otherwise(F.lit(other))


def rsi_label(rsi: Column) -> Column:
    return label(
        rsi,
        [(rsi >= 70, "Overbought"), (rsi <= 30, "Oversold"), (rsi >= 55, "Bullish"), (rsi <= 45, "Bearish")],
        "Neutral",
    )


def _gain_loss_index(gain: Column, loss: Column) -> Column:
    return F.when(F.abs(loss) < TINY, F.lit(100.0)).otherwise(
        100.0 - F.try_divide(F.lit(100.0), 1.0 + F.try_divide(gain, loss))
    )


def numbered(bars: DataFrame) -> DataFrame:
    """(ticker, date, close, n, before): position and the close before, counted inside months and carried over their borders."""
    rows = bars.select("ticker", "date", "close", F.trunc("date", "month").alias("month"))
    inside = Window.partitionBy("ticker", "month").orderBy("date")
    earlier = Window.partitionBy("ticker").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = rows.groupBy("ticker", "month").agg(F.count(F.lit(1)).alias("bars"), F.max_by("close", "date").alias("last_close")).select(
        "ticker", "month", F.coalesce(F.sum("bars").over(earlier), F.lit(0)).alias("_n"),
        F.lag("last_close").over(Window.partitionBy("ticker").orderBy("month")).alias("_close"),
    )
    placed = rows.withColumns({"_k": F.row_number().over(inside), "_before": F.lag("close").over(inside)}).join(months, ["ticker", "month"])
    before = F.when(F.col("_k") == 1, F.col("_close")).otherwise(F.col("_before"))
    return placed.select("ticker", "date", "close", (F.col("_n") + F.col("_k")).alias("n"), before.alias("before"))


def smoothed(rows: DataFrame, means: dict[str, tuple[str, float]], first: int = 1) -> DataFrame:
    """Rows from position ``first`` on with running means: ``means`` gives the value and the weight of a new one by column.

    ``rows`` has (ticker, n) with n counting from 1.  A mean starts as the plain mean of the first ``first`` values; from
    then on it moves by its weight towards each new value.
    """
    seeds = rows.where(F.col("n") <= first).groupBy("ticker").agg(
        *[F.avg(value).alias(f"_{out}") for out, (value, _) in means.items()], F.count(F.lit(1)).alias("_have")
    ).where(F.col("_have") == first)
    place = F.col("n") - first
    cut = rows.where(place >= 0).join(seeds, "ticker").withColumns({"_block": F.floor(place / BLOCK_BARS), "_j": (place % BLOCK_BARS).cast("double")})
    inside = Window.partitionBy("ticker", "_block").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Inside a block: what its own values give, as if nothing came before.
    own = {}
    for out, (value, weight) in means.items():
        keep = F.lit(1.0 - weight)
        new = F.when(place == 0, F.col(f"_{out}")).otherwise(weight * F.col(value))
        own[f"_{out}"] = F.pow(keep, F.col("_j")) * F.sum(new * F.pow(keep, -F.col("_j"))).over(inside)
    local = cut.withColumns(own)
    ends = local.groupBy("ticker", "_block").agg(F.max_by(F.struct("_j", *own), "_j").alias("e"))
    # Over the blocks of a ticker: what each one is handed by those before.
    listed = ends.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("_block", "e"))).alias("blocks"))
    start = F.struct(*[F.lit(0.0).alias(out) for out in means])

    def hand_over(state, block):
        now = state["now"]
        after = F.struct(*[
            (block["e"][f"_{out}"] + F.pow(F.lit(1.0 - weight), block["e"]["_j"] + 1.0) * now[out]).alias(out) for out, (_, weight) in means.items()
        ])
        handed = F.struct(block["_block"].alias("_block"), *[now[out].alias(f"_in_{out}") for out in means])
        return F.struct(after.alias("now"), F.concat(state["handed"], F.array(handed)).alias("handed"))

    kind = "array<struct<_block: bigint, " + ", ".join(f"_in_{out}: double" for out in means) + ">>"
    folded = listed.select("ticker", F.inline(F.aggregate("blocks", F.struct(start.alias("now"), F.array().cast(kind).alias("handed")), hand_over)["handed"]))
    joined = local.join(folded, ["ticker", "_block"])
    full = {out: F.col(f"_{out}") + F.pow(F.lit(1.0 - weight), F.col("_j") + 1.0) * F.col(f"_in_{out}") for out, (_, weight) in means.items()}
    return joined.withColumns(full).select(*rows.columns, *means)


def rsi_series(bars: DataFrame, period: int = 14) -> DataFrame:
    """Relative strength on every bar from the first full period on, with means seeded on the first ``period`` changes."""
    change = F.col("close") - F.col("before")
    moves = numbered(bars).where("n > 1").select(
        "ticker", "date", (F.col("n") - 1).alias("n"),
        F.greatest(change, F.lit(0.0)).alias("up"), F.greatest(-change, F.lit(0.0)).alias("down"),
    )
    means = smoothed(moves, {"gain": ("up", 1.0 / period), "loss": ("down", 1.0 / period)}, period)
    return means.select("ticker", "date", _gain_loss_index(F.col("gain"), F.col("loss")).alias("rsi"))


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Relative strength of the last bar; NULL for a ticker with too few."""
    last = rsi_series(bars, period).groupBy("ticker").agg(F.max_by("rsi", "date").alias("rsi"))
    tickers = bars.select("ticker").distinct()
    return tickers.join(last, "ticker", "left").withColumn("rsi_signal", rsi_label(F.col("rsi")))


def moving_averages(bars: DataFrame) -> DataFrame:
    """50 and 200 bar means, distances in percent and the crossing state, on the last bar."""
    rows = ordered(bars).withColumns(
        {
            "ma50": F.when(F.col("n") >= 50, F.avg("close").over(_last(50))),
            "ma200": F.when(F.col("n") >= 200, F.avg("close").over(_last(200))),
        }
    )

    def gap(a, b):
        return F.when(F.abs(b) > TINY, F.try_divide(F.col(a) - F.col(b), F.col(b)) * 100.0)

    trend = (
        F.when(F.col("ma200").isNull(), F.lit("Insufficient data"))
        .when(F.col("ma50") > F.col("ma200"), F.lit("Golden Cross (Bullish)"))
        .otherwise(F.lit("Death Cross (Bearish)"))
    )
    return newest(rows).select(
        "ticker", "ma50", "ma200", gap("close", "ma50").alias("price_vs_ma50"),
        gap("close", "ma200").alias("price_vs_ma200"), gap("ma50", "ma200").alias("ma50_vs_ma200"),
        trend.alias("ma_trend"),
    )


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two exponential means, its own mean and their gap, on the last bar of tickers with enough of them."""
    rows = smoothed(numbered(bars).select("ticker", "date", "n", "close"), {"fast": ("close", 2.0 / (fast + 1)), "slow": ("close", 2.0 / (slow + 1))})
    rows = rows.select("ticker", "date", "n", (F.col("fast") - F.col("slow")).alias("line"))
    last = smoothed(rows, {"mean": ("line", 2.0 / (signal + 1))}).groupBy("ticker").agg(F.max_by(F.struct("n", "line", "mean"), "n").alias("s"))
    known = F.col("s.n") >= slow + signal
    rows = last.select("ticker", F.when(known, F.col("s.line")).alias("macd"), F.when(known, F.col("s.mean")).alias("macd_signal"))
    line, mean = F.col("macd"), F.col("macd_signal")
    trend = (
        F.when(line.isNull(), F.lit("Insufficient data"))
        .when((line > mean) & (line > 0), F.lit("Strong Bullish"))
        .when((line > mean) & (line < 0), F.lit("Bullish Reversal"))
        .when((line < mean) & (line > 0), F.lit("Bearish Reversal"))
        .otherwise(F.lit("Strong Bearish"))
    )
    return rows.select("ticker", "macd", "macd_signal", (line - mean).alias("macd_histogram"), trend.alias("macd_trend"))


def williams_r(bars: DataFrame, periods: tuple[int, ...] = (14, 2)) -> DataFrame:
    """Distance of the close from the high of the last bars, -100 to 0."""
    rows = ordered(bars)
    out = []
    for p in periods:
        top, bottom = F.max("high").over(_last(p)), F.min("low").over(_last(p))
        rows = rows.withColumns({f"top_{p}": top, f"bottom_{p}": bottom})
        width = F.col(f"top_{p}") - F.col(f"bottom_{p}")
        value = F.when(
            (F.col("n") >= p) & (F.abs(width) >= TINY),
            F.try_divide(F.col(f"top_{p}") - F.col("close"), width) * -100.0,
        )
        name = f"williams_r_{p}"
        text = (
            F.when(F.col("n") < p, F.lit("Insufficient data"))
            .when(F.col(name).isNull(), F.lit("N/A"))
            .when(F.col(name) >= -20, F.lit("Overbought"))
            .when(F.col(name) <= -80, F.lit("Oversold"))
            .otherwise(F.lit("Neutral"))
        )
        rows = rows.withColumn(name, value).withColumn(f"{name}_signal", text)
        out += [name, f"{name}_signal"]
    return newest(rows).select("ticker", *out)


def _cross_label(k: Column, d: Column) -> Column:
    return (
        F.when(k.isNull(), F.lit("Insufficient data"))
        .when(d.isNull(), F.lit("N/A"))
        .when(k >= 80, F.lit("Overbought"))
        .when(k <= 20, F.lit("Oversold"))
        .when(k > d, F.lit("Bullish crossover"))
        .when(k < d, F.lit("Bearish crossover"))
        .otherwise(F.lit("Neutral"))
    )


def _smoothed_pair(rows: DataFrame, raw: str, first: int, k: str, d: str, smooth_k: int, smooth_d: int) -> DataFrame:
    """Two means in a row; a place of the first mean without enough values counts as 50 in the second.

    ``first`` is the bar position of the first raw value.
    """
    rows = rows.withColumn(k, F.when(F.col("n") >= first + smooth_k - 1, F.avg(raw).over(_last(smooth_k))))
    rows = rows.withColumn("_filled", F.when(F.col("n") >= first, F.coalesce(k, F.lit(50.0))))
    return rows.withColumn(
        d, F.when(F.col("n") >= first + smooth_d - 1, F.avg("_filled").over(_last(smooth_d)))
    ).drop("_filled")


def stochastic(bars: DataFrame, period: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> DataFrame:
    """Place of the close in the range of the last bars, smoothed twice."""
    rows = ordered(bars).withColumns(
        {"top": F.max("high").over(_last(period)), "bottom": F.min("low").over(_last(period))}
    )
    width = F.col("top") - F.col("bottom")
    raw = F.when(F.abs(width) < TINY, F.lit(50.0)).otherwise(100.0 * F.try_divide(F.col("close") - F.col("bottom"), width))
    rows = rows.withColumn("raw", F.when(F.col("n") >= period, raw))
    rows = newest(_smoothed_pair(rows, "raw", period, "stoch_k", "stoch_d", smooth_k, smooth_d))
    enough = F.col("n") >= period + smooth_k
    return rows.select(
        "ticker", F.when(enough, F.col("stoch_k")).alias("stoch_k"), F.when(enough, F.col("stoch_d")).alias("stoch_d")
    ).withColumn("stoch_signal", _cross_label(F.col("stoch_k"), F.col("stoch_d")))


def stochastic_rsi(
    bars: DataFrame, period: int = 14, stoch_period: int = 14, smooth_k: int = 3, smooth_d: int = 3
) -> DataFrame:
    """Stochastic of a strength index that uses plain means of gains and losses."""
    change = F.col("close") - F.col("before")
    rows = ordered(bars).withColumns(
        {"gain": F.greatest(change, F.lit(0.0)), "loss": F.greatest(-change, F.lit(0.0))}
    )
    rows = rows.withColumns({"g": F.avg("gain").over(_last(period)), "l": F.avg("loss").over(_last(period))})
    rows = rows.withColumn("index", F.when(F.col("n") >= period + 1, _gain_loss_index(F.col("g"), F.col("l"))))
    rows = rows.withColumns(
        {"top": F.max("index").over(_last(stoch_period)), "bottom": F.min("index").over(_last(stoch_period))}
    )
    width = F.col("top") - F.col("bottom")
    first = period + stoch_period
    raw = F.when(F.abs(width) < TINY, F.lit(50.0)).otherwise(F.try_divide(F.col("index") - F.col("bottom"), width) * 100.0)
    rows = rows.withColumn("raw", F.when(F.col("n") >= first, raw))
    rows = newest(_smoothed_pair(rows, "raw", first, "stochrsi_k", "stochrsi_d", smooth_k, smooth_d))
    return rows.select("ticker", "stochrsi_k", "stochrsi_d").withColumn(
        "stochrsi_signal", _cross_label(F.col("stochrsi_k"), F.col("stochrsi_d"))
    )


def technicals(bars: DataFrame) -> DataFrame:
    """All indicators of the last bar, one row per ticker."""
    out = rsi(bars)
    for part in (moving_averages(bars), macd(bars), williams_r(bars), stochastic(bars), stochastic_rsi(bars)):
        out = out.join(part, "ticker", "left")
    return out
