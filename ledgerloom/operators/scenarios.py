"""Scenario sweeps: every account under every scenario, as closed forms and folds inside the row.

Scenarios are a short constant list exploded onto the account rows, so a sweep needs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GOAL_MONTHS = 1200
SAVING_FIELDS = {
    "scenario": "string", "monthly_contribution": "double", "annual_return_rate": "double",
    "target_value": "double", "projection_years": "int", "inflation_rate": "double",
}
SPENDING_FIELDS = {
    "scenario": "string", "annual_withdrawal": "double", "withdrawal_rate": "double",
    "time_horizon_years": "int", "expected_return": "double", "inflation_rate": "double",
}


def with_scenarios(rows: DataFrame, scenarios: list[dict], fields: dict[str, str]) -> DataFrame:
    """Each row once per scenario; absent fields are NULL."""
    table = F.array(
        *[
            F.struct(*[F.lit(s.get(name)).cast(kind).alias(name) for name, kind in fields.items()])
            for s in scenarios
        ]
    )
    return rows.select("*", F.inline(table))


def monthly_rate(annual: Column) -> Column:
    return F.pow(1.0 + annual, F.lit(1.0 / 12.0)) - 1.0


def future_value(start: Column, rate: Column, paid: Column, months: Column, flat: float = 0.0) -> Column:
    """Value after ``months`` of growth with a payment at the end of each; ``flat`` bounds a rate taken as zero."""
    growth = F.pow(1.0 + rate, months)
    return F.when(F.abs(rate) <= flat, start + paid * months).otherwise(
        start * growth + paid * F.try_divide(growth - 1.0, rate)
    )


def _bind(value: Column, use) -> Column:
    """Names a value inside an expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def projection(values: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Savings outlook per account and scenario.

    ``values`` has account, portfolio_value and cagr (percent, used where a scenario names no rate).  Without a target
    the value after n years is given, with one the first month that reaches it and the rate required to reach it in
    n years (bisection over -20 to 200 percent).
    """
    rows = with_scenarios(values.where("portfolio_value > 0"), scenarios, SAVING_FIELDS)
    rows = rows.withColumns(
        {
            "rate": F.coalesce("annual_return_rate", F.col("cagr") / 100.0, F.lit(0.0)),
            "years": F.greatest("projection_years", F.lit(0)),
        }
    )
    start, paid = F.col("portfolio_value"), F.col("monthly_contribution")
    target, inflation = F.col("target_value"), F.col("inflation_rate")
    rows = rows.withColumn("monthly", monthly_rate(F.col("rate")))

    def grown(months):
        return future_value(start, F.col("monthly"), paid, months)

    first = F.try_element_at(
        F.filter(
            F.sequence(F.lit(1), F.lit(MAX_GOAL_MONTHS)),
            lambda m: grown(m) >= target * F.pow(1.0 + inflation, m / 12.0),
        ),
        F.lit(1),
    )
    reached = target.isNotNull() & (start >= target)
    search = target.isNotNull() & ~(start >= target)
    rows = rows.withColumn("months", F.when(search, first))
    found = search & F.col("months").isNotNull()

    horizon = F.col("years") * 12
    goal = target * F.pow(1.0 + inflation, F.col("years"))

    def at_rate(annual):
        return future_value(start, monthly_rate(annual), paid, horizon)

    def halve(state, _):
        mid = (state["lo"] + state["hi"]) / 2.0

        def move(value):
            stop = (F.abs(value - goal) < 1e-8) | (state["hi"] - state["lo"] < 1e-8)
            low = value < goal
            return F.struct(
                F.when(~stop & low, mid).otherwise(state["lo"]).alias("lo"),
                F.when(~stop & ~low, mid).otherwise(state["hi"]).alias("hi"),
                mid.alias("mid"),
                stop.alias("done"),
            )

        return F.when(state["done"], state).otherwise(_bind(at_rate(mid), move))

    begin = F.struct(
        F.lit(-0.2).alias("lo"), F.lit(2.0).alias("hi"), F.lit(0.0).alias("mid"), F.lit(False).alias("done")
    )
    required = F.aggregate(F.sequence(F.lit(1), F.lit(200)), begin, halve)["mid"]
    open_end = target.isNull()
    nominal = F.when(open_end, grown(horizon))
    total_paid = F.when(open_end, paid * horizon)
    return rows.select(
        "account", "scenario", start.alias("current_value"), F.col("rate").alias("annual_return_rate"),
        "monthly_contribution", "inflation_rate", "target_value",
        F.when(reached, F.lit(0.0)).when(found, F.col("months") / 12.0).alias("years_to_goal"),
        F.when(reached, start).when(found, grown(F.col("months"))).alias("projected_goal_value"),
        F.when(open_end, F.col("years")).alias("projection_years"),
        nominal.alias("projected_value_nominal"),
        F.when(open_end, nominal / F.pow(1.0 + inflation, F.col("years"))).alias("projected_value_real"),
        total_paid.alias("total_contributions"),
        F.when(open_end, nominal - start - total_paid).alias("return_portion"),
        F.when(found & (at_rate(F.lit(2.0)) >= goal), required).alias("required_return_rate"),
    )


ZERO_RATE = 1e-14


def projection_path(
    values: DataFrame, months: int = 120, contribution: float = 0.0, annual_rate_pct: float = 7.0
) -> DataFrame:
    """Month-by-month value, contributions and gain per account."""
    rate = monthly_rate(F.lit(annual_rate_pct / 100.0))
    start, paid = F.col("portfolio_value"), F.lit(contribution)
    path = values.select(
        "account", "portfolio_value", F.explode(F.sequence(F.lit(0), F.lit(months))).alias("month")
    )
    value = future_value(start, rate, paid, F.col("month"), ZERO_RATE)
    put_in = paid * F.col("month")
    return path.select(
        "account", "month",
        F.round(value, 2).alias("value"), F.round(put_in, 2).alias("contribution_sum"),
        F.round(value - start - put_in, 2).alias("gain"),
    )


def accumulation(values: DataFrame, months: int, contribution: float, annual_rate_pct: float) -> DataFrame:
    """The same path as one array per account."""
    rate = monthly_rate(F.lit(annual_rate_pct / 100.0))
    start, paid = F.col("portfolio_value"), F.lit(contribution)

    def worth(month):
        return F.round(future_value(start, rate, paid, month, ZERO_RATE), 2)

    final = future_value(start, rate, paid, F.lit(months), ZERO_RATE)
    return values.select(
        "account", F.transform(F.sequence(F.lit(0), F.lit(months)), worth).alias("values"),
        F.round(final, 2).alias("projected_value"),
        F.round(paid * months, 2).alias("total_contributions"),
        F.round(final - start - paid * months, 2).alias("gain_from_returns"),
    )


def goal_months(
    values: DataFrame, target: Column, contribution: float, annual_rate_pct: float, max_months: int = 600,
    inflation_rate: float = 0.0,
) -> DataFrame:
    """First month at which an account reaches ``target`` (a Column), or the bound it cannot pass."""
    rate = F.lit(annual_rate_pct / 100.0)
    rows = values.select("account", "portfolio_value", target.alias("target"), monthly_rate(rate).alias("monthly"))
    start, paid, goal, monthly = F.col("portfolio_value"), F.lit(contribution), F.col("target"), F.col("monthly")

    def grown(month):
        return future_value(start, monthly, paid, month, ZERO_RATE)

    bound = F.when(monthly < 0, F.greatest(start, F.try_divide(paid, F.abs(monthly))))
    first = F.try_element_at(
        F.filter(
            F.sequence(F.lit(1), F.lit(max_months)),
            lambda m: grown(m) >= goal * F.pow(F.lit(1.0 + inflation_rate), m / 12.0),
        ),
        F.lit(1),
    )
    rows = rows.withColumn(
        "months_needed", F.when(goal <= start, F.lit(0)).when(bound.isNull() | (goal <= bound), first)
    )
    feasible = F.col("months_needed").isNotNull()
    return rows.select(
        "account", "target", feasible.alias("feasible"), "months_needed",
        F.round(F.when(feasible, grown(F.col("months_needed"))).otherwise(grown(F.lit(max_months))), 2).alias(
            "projected_value"
        ),
        F.round(bound, 2).alias("max_achievable"),
    )


def withdrawal(values: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Retirement outlook per account and scenario: depletion, total withdrawn and the largest safe withdrawal.

    Inflation is in percent.  The terminal value is linear in the first withdrawal, so the safe amount is a quotient.
    """
    rows = with_scenarios(values.where("portfolio_value > 0"), scenarios, SPENDING_FIELDS)
    value = F.col("portfolio_value")
    rows = rows.withColumns(
        {
            "rate": F.coalesce("expected_return", F.col("cagr") / 100.0, F.lit(0.0)),
            "infl": F.col("inflation_rate") / 100.0,
            "horizon": F.greatest(F.coalesce("time_horizon_years", F.lit(30)), F.lit(0)),
            "first": F.coalesce(
                "annual_withdrawal", value * F.col("withdrawal_rate") / 100.0, value * 0.04
            ),
        }
    )
    rate, infl, horizon, first = (F.col(c) for c in ("rate", "infl", "horizon", "first"))
    years = F.when(horizon > 0, F.sequence(F.lit(1), F.greatest(horizon, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    none = F.lit(None).cast("double")

    def year(state, t):
        take = first * F.pow(1.0 + infl, t - 1)

        def step(pair):
            end, begin = pair["end"], state["v"]
            gone = state["dep"].isNull() & (end <= 0)
            share = F.when(begin > 0, F.least(F.lit(1.0), F.try_divide(begin, begin - end))).otherwise(F.lit(1.0))
            share = F.when(end == 0, F.lit(1.0)).otherwise(share)
            return F.struct(
                end.alias("v"),
                F.when(gone, t - 1 + share).otherwise(state["dep"]).alias("dep"),
                (
                    state["drawn"]
                    + F.when(state["dep"].isNotNull(), 0.0).when(gone, take * share).otherwise(take)
                ).alias("drawn"),
            )

        return _bind(F.struct((state["v"] * (1.0 + rate) - take).alias("end")), step)

    run = F.aggregate(years, F.struct(value.alias("v"), none.alias("dep"), F.lit(0.0).alias("drawn")), year)
    per_unit = F.aggregate(
        years, F.lit(0.0), lambda acc, t: acc * (1.0 + rate) + F.pow(1.0 + infl, t - 1)
    )
    rows = rows.withColumns({"run": run, "per_unit": per_unit})
    dep, end = F.col("run.dep"), F.col("run.v")
    success = F.when((end >= 0) | (horizon == 0), F.lit(100.0)).otherwise(
        F.when(dep > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * dep / horizon))).otherwise(0.0)
    )
    safe = F.when(horizon > 0, F.try_divide(value * F.pow(1.0 + rate, horizon), F.col("per_unit")))
    shown_end = F.when(dep < horizon, F.lit(0.0)).otherwise(end)
    return rows.select(
        "account", "scenario", "portfolio_value", first.alias("annual_withdrawal"),
        (first / value * 100.0).alias("withdrawal_rate_pct"), horizon.alias("time_horizon_years"),
        rate.alias("expected_return"), "inflation_rate", dep.alias("years_until_depletion"),
        end.alias("terminal_value"), success.alias("success_likelihood"), safe.alias("max_safe_withdrawal"),
        (safe / value * 100.0).alias("max_safe_withdrawal_rate"), F.col("run.drawn").alias("total_withdrawn"),
        (shown_end - value + F.col("run.drawn")).alias("return_generated"), (100.0 - success).alias("shortfall_risk"),
    )
