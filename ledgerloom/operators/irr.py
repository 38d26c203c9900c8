"""Money-weighted return: one internal rate per account, solved inside the row.

Flows are folded to one amount per day before they are gathered, so an account's array is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import classify as C
from ledgerloom.operators.asof import add_rate, clip, daily_rates, day

TOLERANCE = 1e-7
STEPS = 200


def _value_at(rate: Column, flows: Column) -> Column:
    return F.aggregate(flows, F.lit(0.0), lambda acc, f: acc + f["amount"] / F.pow(1.0 + rate, f["years"]))


def _slope_at(rate: Column, flows: Column) -> Column:
    return F.aggregate(
        flows,
        F.lit(0.0),
        lambda acc, f: acc - f["years"] * f["amount"] / F.pow(1.0 + rate, f["years"] + 1.0),
    )


def _newton(flows: Column) -> Column:
    """Struct (rate, done): Newton's method from 10 percent."""
    start = F.struct(F.lit(0.1).alias("rate"), F.lit(False).alias("done"), F.lit(False).alias("stuck"))

    def step(state: Column, _: Column) -> Column:
        rate = state["rate"]
        point = F.struct(_value_at(rate, flows).alias("f"), _slope_at(rate, flows).alias("d"))

        def move(p: Column) -> Column:
            flat = F.abs(p["d"]) < 1e-12
            raw = rate - F.coalesce(F.try_divide(p["f"], p["d"]), F.lit(0.0))
            new = F.when(raw <= -1.0, F.lit(-0.9999)).otherwise(raw)
            hit = F.abs(p["f"]) < TOLERANCE
            return F.struct(
                F.when(hit | flat, rate).otherwise(new).alias("rate"),
                (hit | (~flat & (F.abs(new - rate) < TOLERANCE))).alias("done"),
                (~hit & flat).alias("stuck"),
            )

        moved = F.element_at(F.transform(F.array(point), move), 1)
        return F.when(state["done"] | state["stuck"], state).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)


def _bisect(flows: Column) -> Column:
    """Rate by bisection over [-0.9999, high]; the upper end doubles from 10 until the value changes sign."""
    low = F.lit(-0.9999)
    f_low = _value_at(low, flows)
    highs = F.array(*[F.lit(10.0 * 2**k) for k in range(7)])
    high = F.try_element_at(F.filter(highs, lambda h: f_low * _value_at(h, flows) <= 0), F.lit(1))
    start = F.struct(low.alias("low"), high.alias("high"), f_low.alias("f_low"))

    def step(state: Column, _: Column) -> Column:
        mid = (state["low"] + state["high"]) / 2.0

        def halve(p: Column) -> Column:
            left = state["f_low"] * p["f"] <= 0
            hit = (F.abs(p["f"]) < TOLERANCE) | (state["high"] - state["low"] < TOLERANCE)
            return F.struct(
                F.when(hit | ~left, p["mid"]).otherwise(state["low"]).alias("low"),
                F.when(hit | left, p["mid"]).otherwise(state["high"]).alias("high"),
                F.when(~left, p["f"]).otherwise(state["f_low"]).alias("f_low"),
            )

        point = F.struct(mid.alias("mid"), _value_at(mid, flows).alias("f"))
        halved = F.element_at(F.transform(F.array(point), halve), 1)
        return F.when(state["low"] == state["high"], state).otherwise(halved)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    return F.when(high.isNull(), F.lit(0.0)).otherwise((end["low"] + end["high"]) / 2.0)


def xirr(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Yearly internal rate of dated amounts per key, on 365-day years; 0 where the amounts have one sign.

    ``flows`` has the keys, ``date`` and ``amount``.
    """
    per_day = flows.groupBy(*keys, "date").agg(
        F.sum("amount").alias("amount"),
        F.max(F.col("amount") > 0).alias("any_in"),
        F.max(F.col("amount") < 0).alias("any_out"),
        F.count(F.lit(1)).alias("n"),
    )
    gathered = per_day.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("date", "amount"))).alias("dated"),
        F.max("any_in").alias("any_in"),
        F.max("any_out").alias("any_out"),
        F.sum("n").alias("n"),
    )
    years = F.transform(
        "dated",
        lambda f: F.struct(
            f["amount"].alias("amount"),
            (F.datediff(f["date"], F.element_at("dated", 1)["date"]) / 365.0).alias("years"),
        ),
    )
    solvable = F.col("any_in") & F.col("any_out") & (F.col("n") >= 2)
    solved = gathered.withColumn("flows", years).withColumn(
        "newton", F.when(solvable, _newton(F.col("flows")))
    )
    return solved.select(
        *keys,
        F.when(~solvable, F.lit(0.0))
        .when(F.col("newton.done"), F.col("newton.rate"))
        .otherwise(_bisect(F.col("flows")))
        .alias("irr"),
    )


def account_flows(ledger: DataFrame, prices: DataFrame, values: DataFrame, as_of) -> DataFrame:
    """Deposits as outflows, withdrawals as inflows and the final value, per account."""
    moved = clip(C.classified(ledger.where(F.col("action").isin("DEPOSIT", "WITHDRAW"))), as_of).select(
        "account", "date", "asset", "asset_type",
        F.when(F.col("action") == "DEPOSIT", -F.col("quantity")).otherwise(F.col("quantity")).alias("amount"),
    )
    # Rated per row sign: folding both signs of a day would hide which ones occur.
    per_day = moved.groupBy("account", "date", "asset", "asset_type", (F.col("amount") > 0).alias("incoming")).agg(
        F.sum("amount").alias("amount")
    ).withColumn("key", C.normalize_cash_asset(F.col("asset"), F.col("asset_type")))
    rated = add_rate(per_day, "key", daily_rates(prices, as_of)).select(
        "account", "date", (F.col("amount") * F.col("rate")).alias("amount")
    ).where("amount IS NOT NULL")
    final = values.where("portfolio_value > 0").select(
        "account", day(as_of).alias("date"), F.col("portfolio_value").alias("amount")
    )
    funded = rated.select("account").distinct()
    return rated.join(final.select("account"), "account", "left_semi").unionByName(
        final.join(funded, "account", "left_semi")
    )


def money_weighted_return(ledger: DataFrame, prices: DataFrame, values: DataFrame, as_of) -> DataFrame:
    """Internal rate of each account's external flows; NULL without flows or without a positive value."""
    rates = xirr(account_flows(ledger, prices, values, as_of), ["account"])
    return values.select("account").join(rates, "account", "left").select("account", F.col("irr").alias("mwr"))
