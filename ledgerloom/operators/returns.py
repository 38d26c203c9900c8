"""Daily account values and flow-neutral returns, and the linked returns read off them.

Every window here sees one account (or one instrument of an account) with at most one row per calendar day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify as C
from ledgerloom.functions.stats import log_growth
from ledgerloom.operators.asof import add_rate, always_one, clip, daily_prices, daily_rates, day, usd_units
from ledgerloom.operators.cash import instruments, ledger_legs
from ledgerloom.operators.splits import split_steps, with_split_factor

#: What running sums of a position may be off by, as a part of all that was ever moved.
ROUNDING = 1e-13


@dataclass(frozen=True)
class Opening:
    """What accounts stood at on a day: ``positions`` (account, kind, instrument, date, quantity) and ``accounts`` (account,
    date, adjusted_base).  A ledger that starts after that day goes on from here."""

    positions: DataFrame
    accounts: DataFrame


def position_spans(clipped: DataFrame, until, opening: Opening | None = None) -> DataFrame:
    """Stretches of days over which an account holds a constant, non-zero quantity of an instrument.

    Ledger rows are folded to one move per (account, instrument, day) first; trades are kept in pre-split units and
    scaled by the running split factor, so a split starts a new stretch on its own.  An ``opening`` is one more move.
    """
    legs = with_split_factor(ledger_legs(clipped), split_steps(clipped), "name", "t.leg = 'hold'")
    by_name = legs.groupBy("account", "leg", "name", "date").agg(
        F.sum(F.col("move") / F.col("factor")).alias("move"), F.product("split").alias("split"),
        F.sum(F.abs(F.col("move") / F.col("factor"))).alias("moved"),
    )
    keys = ["account", "kind", "instrument"]
    rows = instruments(by_name).select(*keys, "date", "move", "split", "moved")
    if opening is not None:
        held = F.col("quantity")
        rows = rows.unionByName(opening.positions.select(*keys, "date", held.alias("move"), F.lit(1.0).alias("split"), F.abs(held).alias("moved")))
    moves = (
        rows.groupBy(*keys, "date")
        .agg(F.sum("move").alias("move"), F.product("split").alias("split"), F.sum("moved").alias("moved"))
    )
    order = Window.partitionBy(*keys).orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return moves.select(
        *keys,
        F.col("date").alias("first_day"),
        F.coalesce(F.date_sub(F.lead("date").over(order), 1), day(until)).alias("last_day"),
        (F.sum("move").over(upto) * F.product("split").over(upto)).alias("quantity"),
        (F.abs(F.sum("move").over(upto)) > ROUNDING * F.sum("moved").over(upto)).alias("_open"),
    ).where("_open").drop("_open")


def instrument_values(clipped: DataFrame, prices: DataFrame, until, days=None) -> DataFrame:
    """Dollar value per (account, kind, instrument, day) while the position is open; 0 without a price.

    ``days`` may name a Column of an array of dates built from ``first_day`` and ``last_day``; default all days.
    """
    return _priced_positions(clipped, prices, until, days).drop("priced")


def month_end_positions(spans: DataFrame) -> DataFrame:
    """(account, kind, instrument, date, quantity) on every month end inside the stretches."""
    months = F.sequence(F.trunc("first_day", "month"), F.trunc("last_day", "month"), F.expr("INTERVAL 1 MONTH"))
    ends = spans.select("account", "kind", "instrument", F.explode(F.transform(months, F.last_day)).alias("date"), "quantity", "last_day")
    return ends.where("date <= last_day").drop("last_day")


def _priced_positions(clipped: DataFrame, prices: DataFrame, until, days=None, opening: Opening | None = None) -> DataFrame:
    wanted = F.sequence("first_day", "last_day") if days is None else days
    spread = position_spans(clipped, until, opening).select(
        "account", "kind", "instrument", "quantity", F.explode(wanted).alias("date")
    )
    units = usd_units(daily_prices(prices, until), ("date",)).select(
        F.col("ticker").alias("instrument"), "date", "unit_usd"
    )
    unit = F.when((F.col("kind") == "cash") & always_one(F.col("instrument")), F.lit(1.0)).otherwise(F.col("unit_usd"))
    return spread.join(units, ["instrument", "date"], "left").select(
        "account", "kind", "instrument", "date", "quantity",
        (F.col("quantity") * F.coalesce(unit, F.lit(0.0))).alias("value_usd"),
        unit.isNotNull().alias("priced"),
    )


def unpriced_days(ledger: DataFrame, prices: DataFrame, until) -> DataFrame:
    """(account, date, unpriced): days on which an account holds assets or cash without a price or rate, and how many."""
    held = _priced_positions(clip(C.classified(ledger), until), prices, until)
    return held.where("NOT priced").groupBy("account", "date").agg(F.count(F.lit(1)).alias("unpriced"))


def external_flows(clipped: DataFrame, prices: DataFrame, until) -> DataFrame:
    """Net cash put into each account per day in dollars (deposits minus withdrawals; unrated amounts count 0)."""
    moved = clipped.where(F.col("cash_like") & F.col("action").isin("DEPOSIT", "WITHDRAW")).select(
        "account", "date", "asset", "asset_type",
        F.when(F.col("action") == "DEPOSIT", F.col("quantity")).otherwise(-F.col("quantity")).alias("amount"),
    )
    per_key = moved.groupBy("account", "asset", "asset_type", "date").agg(F.sum("amount").alias("amount"))
    per_key = per_key.withColumn("key", C.normalize_cash_asset(F.col("asset"), F.col("asset_type")))
    rated = add_rate(per_key, "key", daily_rates(prices, until))
    return rated.groupBy("account", "date").agg(
        F.sum(F.col("amount") * F.coalesce("rate", F.lit(0.0))).alias("cash_flow")
    )


def daily_returns(ledger: DataFrame, prices: DataFrame, until, unpriced: str = "refuse", opening: Opening | None = None) -> DataFrame:
    """Value, cash flow and returns of every account on every day from its first row to ``until``.

    A day on which something held has no price would show a false fall and a false recovery, so an account's days end
    before its first such day.  With ``unpriced="zero"`` they go on and what has no price counts 0.

    With an ``opening`` the ledger holds only what came after each account's opening day, and days start there.
    """
    if unpriced not in ("refuse", "zero"):
        raise ValueError(f"unpriced: {unpriced}")
    clipped = clip(C.classified(ledger), until)
    values = (
        _priced_positions(clipped, prices, until, opening=opening)
        .groupBy("account", "date")
        .agg(F.sum("value_usd").alias("value"), F.bool_and("priced").alias("_priced"))
    )
    starts = clipped.select("account", "date")
    if opening is not None:
        starts = starts.unionByName(opening.accounts.select("account", "date"))
    spine = (
        starts.groupBy("account")
        .agg(F.min("date").alias("first_day"))
        .select("account", F.explode(F.sequence("first_day", day(until))).alias("date"))
    )
    rows = (
        spine.join(values, ["account", "date"], "left")
        .join(external_flows(clipped, prices, until), ["account", "date"], "left")
        .select(
            "account", "date",
            F.coalesce("value", F.lit(0.0)).alias("portfolio_value"),
            F.coalesce("cash_flow", F.lit(0.0)).alias("cash_flow"),
            F.coalesce("_priced", F.lit(True)).alias("_priced"),
        )
    )
    order = Window.partitionBy("account").orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if unpriced == "refuse":
        rows = rows.withColumn("_sound", F.bool_and("_priced").over(upto)).where("_sound")
    value, before = F.col("portfolio_value"), F.col("before")
    rows = rows.withColumn("before", F.lag("portfolio_value").over(order))
    rows = rows.withColumn(
        "cash_flow_impact", F.when(before.isNull(), F.lit(0.0)).otherwise(F.col("cash_flow"))
    )

    def pct(change):
        return F.when(before > 0, F.try_divide(change, before) * 100.0).otherwise(F.lit(0.0))

    base = F.first("portfolio_value").over(upto)
    if opening is not None:
        rows = rows.join(opening.accounts.select("account", F.col("adjusted_base").alias("_base")), "account", "left")
        base = F.coalesce("_base", base)
    return rows.select(
        "account", "date", "portfolio_value",
        pct(value - before).alias("portfolio_daily_return"),
        pct(value - before - F.col("cash_flow_impact")).alias("investment_return"),
        "cash_flow_impact",
        (base + F.sum("cash_flow_impact").over(upto)).alias("adjusted_base"),
    )


def daily_log(daily: DataFrame) -> DataFrame:
    return daily.withColumn("log_growth", log_growth(F.col("investment_return") / 100.0))


def period_returns(daily: DataFrame, as_of) -> DataFrame:
    """Linked return over 1M, 3M, 6M, YTD, 1Y and since inception, in one pass of conditional sums."""
    end = day(as_of)
    starts = {
        "1M": F.add_months(end, -1),
        "3M": F.add_months(end, -3),
        "6M": F.add_months(end, -6),
        "YTD": F.trunc(end, "year"),
        "1Y": F.add_months(end, -12),
    }
    rows = daily_log(daily.where((F.col("date") <= end) & (F.col("portfolio_value") > 0)))
    sums = {
        name: F.sum(F.when(F.col("date") >= start, F.col("log_growth"))) for name, start in starts.items()
    }
    accounts = daily.groupBy("account").agg(F.lit(0).alias("unused")).drop("unused")
    agg = rows.groupBy("account").agg(
        F.min("date").alias("first_day"),
        F.sum("log_growth").alias("SII"),
        *[s.alias(n) for n, s in sums.items()],
    )
    starts["SII"] = F.coalesce("first_day", end)
    table = F.array(
        *[
            F.struct(F.lit(n).alias("period"), s.alias("from_date"), F.col(n).alias("log_sum"))
            for n, s in starts.items()
        ]
    )
    return accounts.join(agg, "account", "left").select("account", F.inline(table)).select(
        "account", "period", "from_date",
        F.coalesce((F.exp("log_sum") - 1.0) * 100.0, F.lit(0.0)).alias("return_pct"),
    )


def rolling_returns(daily: DataFrame, as_of, window_months: int = 12) -> DataFrame:
    """Linked return over the months before each month end, once the history is that long.

    The half-open window (month end - n months, month end] is a difference of running sums, so the second look-up
    is an equi-join on (account, date) with the month ends.
    """
    rows = daily_log(daily.where(F.col("date") <= day(as_of)))
    order = Window.partitionBy("account").orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.col("portfolio_value") > 0
    summed = rows.select(
        "account", "date",
        F.coalesce(F.sum(F.when(held, F.col("log_growth"))).over(upto), F.lit(0.0)).alias("log_sum"),
        F.min(F.when(held, F.col("date"))).over(upto).alias("first_day"),
        F.coalesce(F.trunc(F.lead("date").over(order), "month") != F.trunc("date", "month"), F.lit(True)).alias(
            "month_end"
        ),
    )
    ends = summed.where("month_end").withColumn("start", F.add_months("date", -window_months))
    ends = ends.where(F.col("first_day") <= F.col("start"))
    starts = summed.select("account", F.col("date").alias("start"), F.col("log_sum").alias("start_sum"))
    return ends.join(starts, ["account", "start"]).select(
        "account", "date",
        ((F.exp(F.col("log_sum") - F.col("start_sum")) - 1.0) * 100.0).alias("return_pct"),
    )


def last_days(daily: DataFrame, as_of, days: int) -> DataFrame:
    """Rows of the last ``days`` days of each account, with their rank from the end."""
    newest = Window.partitionBy("account").orderBy(F.col("date").desc())
    return (
        daily.where(F.col("date") <= day(as_of))
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= days)
    )


def widget(daily: DataFrame, account_status: DataFrame, as_of, days: int) -> DataFrame:
    """Value, change of the day, total gain and the recent value series per account."""
    recent = last_days(daily, as_of, days + 1)

    def at(rank, name):
        return F.max(F.when(F.col("rank") == rank, F.col(name)))

    point = F.struct("date", F.col("portfolio_value").alias("value"))
    per_account = recent.groupBy("account").agg(
        at(1, "date").alias("last_refresh"),
        F.coalesce(at(1, "portfolio_value") - at(2, "portfolio_value"), F.lit(0.0)).alias("today_amount"),
        F.coalesce(at(1, "investment_return"), F.lit(0.0)).alias("today_pct"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= days, point))).alias("series"),
    )
    return account_status.join(per_account, "account", "left").select(
        "account",
        F.col("as_of_date"),
        "last_refresh",
        F.col("portfolio_value").alias("value"),
        F.coalesce("today_amount", F.lit(0.0)).alias("today_amount"),
        F.coalesce("today_pct", F.lit(0.0)).alias("today_pct"),
        F.col("total_gain").alias("total_amount"),
        F.col("total_gain_pct").alias("total_pct"),
        "series",
    )
