"""Market regime and the monthly buy map as rules over monthly rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify as C
from ledgerloom.operators.asof import clip, daily_prices
from ledgerloom.operators.indicators import rsi_series
from ledgerloom.operators.returns import instrument_values, rolling_returns

# Levels at which an indicator counts as a peak.
CAPE_PEAK = 30.0
FEAR_GREED_PEAK = 75.0
UNRATE_PEAK = 3.8
UNRATE_OK_TO = 4.8


def with_sma(bars: DataFrame, ticker: str, n: int) -> DataFrame:
    """Close of one ticker with its mean over the last ``n`` bars, once there are that many."""
    order = Window.partitionBy("ticker").orderBy("date")
    span = order.rowsBetween(-(n - 1), Window.currentRow)
    mean = F.when(F.row_number().over(order) >= n, F.avg("close").over(span))
    return bars.where(F.col("ticker") == ticker).select("ticker", "date", "close", mean.alias("sma"))


def month_ends(bars: DataFrame) -> DataFrame:
    """Last row of each ticker and month, dated at the month's end."""
    month = F.last_day("date").alias("month")
    values = [c for c in bars.columns if c not in ("ticker", "date")]
    return bars.groupBy("ticker", month).agg(*[F.max_by(c, "date").alias(c) for c in values])


def regime_of(peaks: Column, missing: Column) -> Column:
    return (
        F.when(missing > 1, F.lit("CAUTION"))
        .when(peaks <= 1, F.lit("AGGRESSIVE"))
        .when(peaks == 2, F.lit("CAUTION"))
        .otherwise(F.lit("PROTECTION"))
    )


def macro_regime(observations: DataFrame, bars: DataFrame, index: str = "SPY") -> DataFrame:
    """Regime per month from valuation, sentiment, unemployment and the index against its 200-bar mean.

    ``observations`` has one row per month end (date, cape, fear_greed, unrate), any value NULL when missing.
    Unemployment and the index are taken as of the month: the last value there is.  Valuation and sentiment count
    for their own month only.  The window runs over one row a month.
    """
    spx = month_ends(with_sma(bars, index, 200)).select(
        F.col("month").alias("date"), F.col("close").alias("spx_price"), F.col("sma").alias("sma200")
    )
    spx = spx.where("sma200 IS NOT NULL")
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index_row = F.when(F.col("sma200").isNotNull(), F.struct("spx_price", "sma200"))
    rows = observations.join(spx, "date", "full").withColumns(
        {
            "unrate": F.last("unrate", ignorenulls=True).over(upto),
            "_index": F.last(index_row, ignorenulls=True).over(upto),
        }
    ).join(observations.select("date"), "date", "left_semi").select(
        "date", "cape", "fear_greed", "unrate", "_index.spx_price", "_index.sma200"
    )
    flags = [
        F.col("cape") > CAPE_PEAK,
        F.col("fear_greed") > FEAR_GREED_PEAK,
        F.col("unrate") <= UNRATE_PEAK,
        F.col("spx_price") <= F.col("sma200"),
    ]
    values = [F.col(c) for c in ("cape", "fear_greed", "unrate", "spx_price")]
    rows = rows.withColumns(
        {
            "peak_count": sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0)),
            "missing_count": sum((F.when(v.isNull(), 1).otherwise(0) for v in values), F.lit(0)),
        }
    )
    peaks, missing = F.col("peak_count"), F.col("missing_count")
    reason = F.when(missing > 1, F.concat(missing.cast("string"), F.lit(" indicators missing"))).otherwise(
        F.concat(peaks.cast("string"), F.lit(" PEAK"))
    )
    return rows.select(
        "date", "cape", "fear_greed", "unrate", "spx_price", "sma200",
        F.col("unrate").between(UNRATE_PEAK, UNRATE_OK_TO).alias("unrate_ok_band"),
        (F.col("unrate") > UNRATE_OK_TO).alias("labor_warning"),
        "peak_count", "missing_count", regime_of(peaks, missing).alias("regime"), reason.alias("regime_reason"),
    )


@dataclass(frozen=True)
class BuyPlan:
    """Parameters of the monthly buy map (defaults are fixed values)."""

    budget: float = 1000.0
    weights: dict[str, float] = field(default_factory=lambda: {"SPYM": 0.80, "SCHD": 0.10, "XLU": 0.05})
    cash_fund: str = "SGOV"
    core: str = "SPYM"
    rsi_caps: dict[str, float] = field(default_factory=lambda: {"SPYM": 70.0, "SCHD": 65.0, "XLU": 65.0})
    sma_bars: int = 90
    ceiling: float = 0.45
    target_low: float = 0.25
    surcharge_above: float = 0.30
    surcharge: float = 1000.0
    fear_below: float = 20.0
    fear_bonus: float = 60.0
    cash_extra: float = 0.10
    least_risk: float = 0.80
    standing: dict[str, float] = field(default_factory=lambda: {"BTC-USD": 100.0})
    kill_months: int = 6


# Cash keys that count as idle cash besides the cash fund.
IDLE_CASH = ("USD", "USDT", "USDC", "GBPUSD=X", "EURUSD=X")


def month_shares(ledger: DataFrame, prices: DataFrame, until, cash_fund: str = "SGOV") -> DataFrame:
    """Share of idle cash and the cash fund in each account's value at every month end."""
    month_days = F.expr(
        "filter(transform(sequence(trunc(first_day, 'month'), last_day, interval 1 month), d -> last_day(d)), "
        "d -> d BETWEEN first_day AND last_day)"
    )
    rows = instrument_values(clip(C.classified(ledger), until), prices, until, month_days)
    idle = ((F.col("kind") == "cash") & F.col("instrument").isin(*IDLE_CASH)) | (
        (F.col("kind") == "asset") & (F.col("instrument") == cash_fund)
    )
    return rows.groupBy("account", F.col("date").alias("month")).agg(
        F.sum("value_usd").alias("portfolio_value"),
        F.sum(F.when(idle, F.col("value_usd")).otherwise(0.0)).alias("idle_usd"),
    ).select(
        "account", "month", "portfolio_value", "idle_usd",
        F.when(F.col("portfolio_value") > 0, F.try_divide("idle_usd", "portfolio_value")).alias("idle_share"),
    )


def buy_filters(bars: DataFrame, plan: BuyPlan) -> DataFrame:
    """Per month and risk fund: strength index, 90-bar mean and whether the fund may be bought."""
    order = Window.partitionBy("ticker").orderBy("date")
    span = order.rowsBetween(-(plan.sma_bars - 1), Window.currentRow)
    funds = bars.where(F.col("ticker").isin(*plan.weights))
    mean = F.when(F.row_number().over(order) >= plan.sma_bars, F.avg("close").over(span))
    rows = funds.select("ticker", "date", "close", mean.alias("sma"))
    rows = month_ends(rows.join(rsi_series(funds), ["ticker", "date"], "left"))
    cap = F.create_map(*[F.lit(x) for item in plan.rsi_caps.items() for x in item])
    passes = (F.col("rsi") < F.try_element_at(cap, F.col("ticker"))) | (F.col("close") < F.col("sma"))
    return rows.select("ticker", "month", "close", "sma", "rsi", F.coalesce(passes, F.lit(False)).alias("passes"))


def buy_map(
    shares: DataFrame, regimes: DataFrame, filters: DataFrame, plan: BuyPlan | None = None, trailing: DataFrame | None = None
) -> DataFrame:
    """Planned purchases per account, month and fund.

    * A blocked fund's amount is deferred to the next round in which the core fund may be bought, never moved into the
      cash fund; so is budget that no fund was planned to get.  ``carried_usd`` is what a round finds waiting.
    * At or above the cash ceiling all new money goes to the core fund; while idle cash exceeds the surcharge level the
      core fund gets a fixed extra.  The cash fund is bought below the target band only, with the budget left.
    * Deep fear moves a bonus out of the cash fund into the risk funds by weight (a negative ``buy_usd`` is a sale).
    * The month after two months above the ceiling gives ten points more to the risk funds; to the core fund alone
      while idle cash is still at the ceiling.
    * ``kill_switch`` is set after ``kill_months`` months in a row above the ceiling when ``trailing`` (the rows of
      ``underperformance``) has an alert over 24 months.
    * An AGGRESSIVE month plans at least ``least_risk`` of the budget for risk funds, unless the switch is set;
      ``below_risk_floor`` says that filters, all of them known, held purchases under it.
    * Standing orders are bought every month at any price.

    An account has one row a month here; windows run over an account's months.
    """
    plan = plan or BuyPlan()
    funds, weight = list(plan.weights), sum(plan.weights.values())
    by_month = Window.partitionBy("account").orderBy("month")
    share, above = F.coalesce("idle_share", F.lit(0.0)), F.col("idle_share") > plan.ceiling
    streak = F.count(F.when(above, 1)).over(by_month.rowsBetween(1 - plan.kill_months, Window.currentRow))
    rows = shares.select(
        "account", "month", "idle_share", share.alias("share"), (streak == plan.kill_months).alias("long_high"),
        F.coalesce(F.lag(above, 1).over(by_month) & F.lag(above, 2).over(by_month), F.lit(False)).alias("step"),
    ).join(regimes.select(F.col("date").alias("month"), "regime", "fear_greed"), "month", "left")
    if trailing is None:
        rows = rows.withColumn("behind", F.lit(False))
    else:
        alerts = trailing.where("alert AND window_months = 24").select("account", F.col("date").alias("month"))
        rows = rows.join(alerts.distinct().withColumn("behind", F.lit(True)), ["account", "month"], "left")
    by_fund = filters.groupBy("month").agg(
        *[F.max(F.when(F.col("ticker") == f, F.struct("rsi", "passes"))).alias(f"f{i}") for i, f in enumerate(funds)]
    )
    rows = rows.join(by_fund, "month", "left").withColumns(
        {
            "regime": F.coalesce("regime", F.lit("CAUTION")),
            "kill_switch": F.col("long_high") & F.coalesce("behind", F.lit(False)),
            "fear": F.coalesce(F.col("fear_greed") < plan.fear_below, F.lit(False)),
            "high": F.col("share") >= plan.ceiling,
        }
    )
    high, none = F.col("high"), F.lit(0.0)
    floored = (F.col("regime") == "AGGRESSIVE") & ~F.col("kill_switch")
    planned = {}
    for i, fund in enumerate(funds):
        part, core = plan.weights[fund] / weight, fund == plan.core
        base = F.when(high, F.lit(plan.budget if core else 0.0)).otherwise(plan.budget * plan.weights[fund])
        if core:
            base = base + F.when(floored & ~high, max(0.0, plan.least_risk - weight) * plan.budget).otherwise(none)
        step = F.when(high, F.lit(1.0 if core else 0.0)).otherwise(part) * plan.budget * plan.cash_extra
        planned[f"base{i}"] = base
        planned[f"bonus{i}"] = F.when(F.col("fear"), plan.fear_bonus * part).otherwise(none) + F.when(
            F.col("step"), step
        ).otherwise(none)
        planned[f"more{i}"] = F.when(F.col("share") > plan.surcharge_above, plan.surcharge).otherwise(none) if core else none
        planned[f"ok{i}"] = F.coalesce(F.col(f"f{i}.passes"), F.lit(False))
    rows = rows.withColumns(planned)
    n = range(len(funds))
    low = F.col("share") < plan.target_low
    unplanned = F.greatest(plan.budget - sum((F.col(f"base{i}") for i in n), none), none)
    wanted = [F.col(f"base{i}") + F.col(f"bonus{i}") + F.col(f"more{i}") for i in n]
    held = sum((F.when(F.col(f"ok{i}"), none).otherwise(wanted[i]) for i in n), none)
    bought = sum((F.when(F.col(f"ok{i}"), F.col(f"base{i}") + F.col(f"bonus{i}")).otherwise(none) for i in n), none)
    known = F.lit(True)
    for i in n:
        known = known & F.col(f"f{i}.passes").isNotNull()
    core_ok = F.col(f"ok{funds.index(plan.core)}")
    rows = rows.withColumns(
        {
            "cash_base": F.when(low, unplanned).otherwise(none),
            "held": held + F.when(low, none).otherwise(unplanned),
            "below_risk_floor": floored & known & (bought < plan.least_risk * plan.budget),
            "_round": F.coalesce(
                F.sum(core_ok.cast("long")).over(by_month.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        }
    ).withColumn("_before", F.coalesce(F.lag("held").over(by_month), none))
    this_round = Window.partitionBy("account", "_round").orderBy("month")
    rows = rows.withColumn("pool", F.sum("_before").over(this_round.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def slot(ticker, rsi, base, bonus, more, carried, ok):
        amount = base + bonus + more
        return F.struct(
            F.lit(ticker).alias("ticker"), rsi.cast("double").alias("rsi"), base.alias("base_usd"), bonus.alias("bonus_usd"),
            more.alias("surcharge_usd"), carried.alias("carried_usd"),
            F.when(ok, amount + carried).otherwise(none).alias("buy_usd"),
            F.when(ok, none).otherwise(amount).alias("deferred_usd"),
        )

    slots = [
        slot(
            fund, F.col(f"f{i}.rsi"), F.col(f"base{i}"), F.col(f"bonus{i}"), F.col(f"more{i}"),
            F.col("pool") if fund == plan.core else none, F.col(f"ok{i}"),
        )
        for i, fund in enumerate(funds)
    ]
    always, no_rsi = F.lit(True), F.lit(None)
    from_cash = F.when(F.col("fear"), F.lit(-plan.fear_bonus)).otherwise(none)
    slots.append(slot(plan.cash_fund, no_rsi, F.col("cash_base"), from_cash, none, none, always))
    slots += [slot(t, no_rsi, F.lit(usd), none, none, none, always) for t, usd in plan.standing.items()]
    return rows.select(
        "account", "month", "regime", "kill_switch", "below_risk_floor", "idle_share", F.inline(F.array(*slots))
    )


def underperformance(daily: DataFrame, prices: DataFrame, as_of, benchmark: str = "SPY") -> DataFrame:
    """Month ends at which an account trails the benchmark by 10 points over 12 months or 20 over 24."""
    level = daily_prices(prices.where(F.col("ticker") == benchmark), as_of).select("date", "price")
    out = None
    for months, limit in ((12, 10.0), (24, 20.0)):
        own = rolling_returns(daily, as_of, months).withColumn("start", F.add_months("date", -months))
        begin = level.select(F.col("date").alias("start"), F.col("price").alias("first"))
        both = own.join(level, "date").join(begin, "start")
        bench = (F.try_divide("price", "first") - 1.0) * 100.0
        part = both.select(
            "account", "date", F.lit(months).alias("window_months"), "return_pct", bench.alias("benchmark_pct"),
            (bench - F.col("return_pct")).alias("shortfall_pct"),
            ((bench - F.col("return_pct")) > limit).alias("alert"),
        )
        out = part if out is None else out.unionByName(part)
    return out
