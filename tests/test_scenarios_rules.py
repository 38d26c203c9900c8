import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import irr, rules, scenarios


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([("a", 100000.0, 5.0)], "account string, portfolio_value double, cagr double")


def test_projection(values):
    rows = {
        r.scenario: r
        for r in scenarios.projection(
            values,
            [
                {"scenario": "fv", "monthly_contribution": 1000.0, "annual_return_rate": 0.12, "projection_years": 10, "inflation_rate": 0.0},
                {"scenario": "goal", "monthly_contribution": 1000.0, "annual_return_rate": 0.07, "target_value": 250000.0,
                 "projection_years": 10, "inflation_rate": 0.03},
                {"scenario": "have", "monthly_contribution": 0.0, "target_value": 90000.0, "projection_years": 1, "inflation_rate": 0.0},
                {"scenario": "never", "monthly_contribution": 0.0, "annual_return_rate": 0.0, "target_value": 2e5, "projection_years": 1, "inflation_rate": 0.0},
            ],
        ).collect()
    }
    assert rows["fv"].projected_value_nominal == pytest.approx(532514.86, abs=0.005)
    assert rows["fv"].return_portion == pytest.approx(532514.86 - 220000, abs=0.005)
    goal = rows["goal"]
    rate, months = 1.07 ** (1 / 12) - 1, round(goal.years_to_goal * 12)

    def worth(n):
        return 100000 * (1 + rate) ** n + 1000 * ((1 + rate) ** n - 1) / rate

    assert worth(months) >= 250000 * 1.03 ** (months / 12) > 0 and worth(months - 1) < 250000 * 1.03 ** ((months - 1) / 12)
    m = (1 + goal.required_return_rate) ** (1 / 12) - 1
    assert 100000 * (1 + m) ** 120 + 1000 * ((1 + m) ** 120 - 1) / m == pytest.approx(250000 * 1.03**10, rel=1e-6)
    assert (rows["have"].years_to_goal, rows["have"].projected_goal_value) == (0.0, 100000.0)
    assert rows["never"].years_to_goal is None


def test_withdrawal(values):
    row = scenarios.withdrawal(
        values,
        [{"scenario": "w", "annual_withdrawal": 15000.0, "time_horizon_years": 10, "expected_return": 0.05, "inflation_rate": 3.0}],
    ).first()
    assert row.total_withdrawn == pytest.approx(122895.08, abs=0.005)
    v = 100000.0
    for t in range(10):
        v = v * 1.05 - row.max_safe_withdrawal * 1.03**t
    assert v == pytest.approx(0.0, abs=1e-6)
    assert row.success_likelihood + row.shortfall_risk == 100.0


def test_paths(values):
    path = scenarios.projection_path(values, 12, 100.0, 0.0).orderBy("month").collect()
    assert (path[0].value, path[12].value, path[12].gain) == (100000.0, 101200.0, 0.0)
    blocked = scenarios.goal_months(values, F.lit(200000.0), 10.0, -5.0).first()
    assert not blocked.feasible and blocked.max_achievable == 100000.0
    assert scenarios.accumulation(values, 3, 1.0, 0.0).first()["values"] == [100000.0, 100001.0, 100002.0, 100003.0]


def test_irr_edges(spark):
    day = dt.date(2024, 1, 1)
    rows = [("one", day, 5.0), ("one", day + dt.timedelta(365), 5.0), ("ten", day, -100.0), ("ten", day + dt.timedelta(365), 110.0),
            ("lost", day, -100.0), ("lost", day + dt.timedelta(365), 1.0), ("big", day, -1.0), ("big", day + dt.timedelta(365), 400.0)]
    got = {r.k: r.irr for r in irr.xirr(spark.createDataFrame(rows, "k string, date date, amount double"), ["k"]).collect()}
    assert got["one"] == 0.0
    assert got["ten"] == pytest.approx(0.1, abs=1e-6)
    assert got["lost"] == pytest.approx(-0.99, abs=1e-5)
    assert got["big"] == pytest.approx(399.0, rel=1e-5)


@pytest.mark.parametrize(
    "values,regime,peaks",
    [
        ((30.0, 75.0, 3.9), "AGGRESSIVE", 0),
        ((31.0, 50.0, 4.5), "AGGRESSIVE", 1),
        ((31.0, 76.0, 4.5), "CAUTION", 2),
        ((31.0, 76.0, 3.8), "PROTECTION", 3),
        ((None, None, 4.5), "CAUTION", 0),
    ],
)
def test_regime(spark, values, regime, peaks):
    month_end = dt.date(2024, 12, 31)
    bars = [("SPY", dt.date(2024, 1, 1) + dt.timedelta(i), float(100 + i)) for i in range(366)]
    bars = spark.createDataFrame(bars, "ticker string, date date, close double")
    obs = spark.createDataFrame([(month_end, *values)], "date date, cape double, fear_greed double, unrate double")
    row = rules.macro_regime(obs, bars).first()
    assert (row.regime, row.peak_count) == (regime, peaks)


def test_buy_map_routes_and_defers(spark):
    m1, m2 = dt.date(2024, 1, 31), dt.date(2024, 2, 29)
    shares = spark.createDataFrame([("a", m1, 0.5), ("a", m2, 0.6), ("b", m2, 0.1)], "account string, month date, idle_share double")
    regimes = spark.createDataFrame([(m1, "AGGRESSIVE", 50.0), (m2, "AGGRESSIVE", 10.0)], "date date, regime string, fear_greed double")
    filters = spark.createDataFrame(
        [(t, m, 50.0, t != "XLU") for t in ("SPYM", "SCHD", "XLU") for m in (m1, m2)], "ticker string, month date, rsi double, passes boolean"
    )
    rows = {(r.account, r.month, r.ticker): r for r in rules.buy_map(shares, regimes, filters).collect()}
    assert rows[("a", m1, "SPYM")].buy_usd == 2000.0
    assert rows[("a", m1, "SCHD")].buy_usd == 0.0 and rows[("a", m1, "SGOV")].buy_usd == 0.0
    # Two high months so far: the step starts in the next one.
    assert rows[("a", m2, "SPYM")].buy_usd == pytest.approx(2000 + 60 * 0.8 / 0.95)
    assert rows[("a", m2, "SGOV")].buy_usd == -60.0
    assert rows[("b", m2, "SGOV")].buy_usd == 50.0 - 60.0
    assert rows[("b", m2, "XLU")].buy_usd == 0.0 and rows[("b", m2, "XLU")].deferred_usd > 50.0
    assert rows[("b", m2, "BTC-USD")].buy_usd == 100.0


def test_buy_map_carries_steps_and_stops(spark):
    months = [dt.date(2024, m, 28) for m in range(1, 9)]
    core_open = [True, False, False, True, True, True, True, True]
    shares = spark.createDataFrame(
        [("low", m, 0.1) for m in months] + [("mid", m, 0.28) for m in months] + [("high", m, 0.5) for m in months],
        "account string, month date, idle_share double",
    )
    regimes = spark.createDataFrame([(m, "AGGRESSIVE", 50.0) for m in months], "date date, regime string, fear_greed double")
    filters = spark.createDataFrame(
        [(t, m, 50.0, ok if t == "SPYM" else t == "SCHD") for m, ok in zip(months, core_open) for t in ("SPYM", "SCHD", "XLU")],
        "ticker string, month date, rsi double, passes boolean",
    )
    trailing = spark.createDataFrame([("high", months[6], 24, True)], "account string, date date, window_months int, alert boolean")
    got = rules.buy_map(shares, regimes, filters, trailing=trailing).collect()
    rows = {(r.account, months.index(r.month), r.ticker): r for r in got}
    core = lambda account, i: rows[(account, i, "SPYM")]
    # XLU is deferred every month, the core fund in two of them; all of it waits for the core fund's next round.
    assert [round(core("low", i).carried_usd) for i in range(6)] == [0, 50, 900, 1750, 50, 50]
    assert [round(core("low", i).buy_usd) for i in range(6)] == [800, 0, 0, 2550, 850, 850]
    # In the target band the cash fund's part is left over and waits too.
    assert [round(core("mid", i).carried_usd) for i in range(5)] == [0, 100, 1000, 1900, 100]
    assert all(rows[("mid", i, "SGOV")].buy_usd == 0 for i in range(8))
    assert [core("high", i).bonus_usd for i in range(4)] == [0.0, 0.0, 100.0, 100.0]
    assert [core("high", i).kill_switch for i in range(8)] == [False] * 6 + [True, False]
    assert [core("low", i).below_risk_floor for i in range(4)] == [False, True, True, False]


def test_regime_takes_the_last_known_unemployment(spark):
    ends = [dt.date(2024, 11, 30), dt.date(2024, 12, 31)]
    obs = spark.createDataFrame([(ends[0], 20.0, 50.0, 3.5), (ends[1], None, 50.0, None)], "date date, cape double, fear_greed double, unrate double")
    bars = [("SPY", dt.date(2024, 1, 1) + dt.timedelta(i), float(100 + i)) for i in range(330)]
    bars = spark.createDataFrame(bars, "ticker string, date date, close double")
    rows = {r.date: r for r in rules.macro_regime(obs, bars).collect()}
    assert (rows[ends[1]].unrate, rows[ends[1]].missing_count, rows[ends[1]].peak_count) == (3.5, 1, 1)
    assert rows[ends[1]].spx_price == rows[ends[0]].spx_price
