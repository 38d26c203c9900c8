"""One account over two years: daily rows, 36 performance figures, internal rate, status and one gain row."""

import pytest

from ledgerloom.operators import fifo, holdings, irr, performance, returns, status
from ledgerloom.sources.store import materialize

# The ledger, its quotes and the figures expected of them.
AS_OF = "2026-01-05"
DATES = (
    "2024-01-02", "2024-03-01", "2024-06-03", "2024-09-03", "2024-12-02",
    "2025-03-03", "2025-06-02", "2025-09-02", "2025-12-01", "2026-01-05",
)
QUOTES = {
    "AAA": (100, 110, 120, 80, 90, 115, 130, 125, 140, 150),
    "BBB": (100, 95, 90, 70, 75, 80, 85, 95, 100, 105),
    "SPY": (100, 102, 105, 95, 98, 110, 118, 116, 125, 130),
}
VALUES = (9985, 10385, 13785, 11505, 12055, 13401, 14295, 13445, 16045, 16495)
PERFORMANCE = {
    "avg_daily_return": 0.0802986485, "avg_drawdown": 9.4454642633, "avg_drawdown_duration": 181.0,
    "avg_investment_return": 0.030274452, "beta": 1.1449134917, "cagr": 10.1986108363,
    "calmar_ratio": 0.6166133789, "cvar_95": -0.0227506425, "cvar_99": -0.0227506425,
    "down_capture_ratio": 1.3807629162, "end_value": 16495.0, "hist_volatility": 13.4123200758,
    "information_ratio": -3.5365247628, "jensens_alpha": -5.4788047056, "max_drawdown": 16.5397170838,
    "median_monthly_return": 0.0, "real_cagr": 7.5108398403, "real_total_return_pct": 57.2004405087,
    "relative_return": -3.7476328241, "sharpe_ratio": 0.6112746184, "sortino_ratio": 0.5777473923,
    "spy_cagr_pct": 13.9462436605, "spy_twr_pct": 30.0, "start_value": 9985.0, "std_dev": 0.8448967482,
    "time_weighted_return_pct": 21.5503997295, "total_days": 735, "total_gain": 2151.8074129888,
    "total_return_pct": 65.197796695, "tracking_error": 46.7510829903, "treynor_ratio": 0.0716089984,
    "up_capture_ratio": 0.9585223472, "var_95": 0.0, "var_99": 0.0,
}
STATUS = {
    "cost_basis": 5815.0, "deposits": 15000, "fees": 75.0, "income": 120, "portfolio_value": 16495.0,
    "realized_gain": 590.0, "taxes": 0.0, "total_gain": 2495.0, "total_gain_pct": 17.8214285714,
    "total_invested": 14000, "total_profit": 2425.0, "unrealized_gain": 1835.0, "withdrawals": 1000,
}


@pytest.fixture(scope="module")
def ledger(make_ledger):
    return make_ledger(
        [
            ("2024-01-02", "USD", "DEPOSIT", 10000, None, 0),
            ("2024-01-02", "AAA", "BUY", 50, 100, 10, "USD", "USD"),
            ("2024-01-02", "BBB", "BUY", 20, 100, 5, "USD", "USD"),
            ("2024-06-03", "USD", "DEPOSIT", 3000, None, 0),
            ("2024-09-03", "USD", "DIVIDEND", 120, None, 0),
            ("2024-12-02", "USD", "FEE", 50, None, 0),
            ("2025-03-03", "BBB", "BUY", 10, 80, 4, "USD", "USD"),
            ("2025-06-02", "AAA", "SELL", 20, 130, 6, "USD", "USD"),
            ("2025-09-02", "USD", "WITHDRAW", 1000, None, 0),
            ("2025-12-01", "USD", "DEPOSIT", 2000, None, 0),
        ]
    )


@pytest.fixture(scope="module")
def prices(make_prices):
    return make_prices([(t, x, p) for t, row in QUOTES.items() for x, p in zip(DATES, row)])


@pytest.fixture(scope="module")
def daily(ledger, prices):
    return materialize(returns.daily_returns(ledger, prices, AS_OF), "golden-daily")


def test_daily_rows(daily):
    rows = {str(r.date): r for r in daily.collect()}
    assert len(rows) == 735
    assert [rows[x].portfolio_value for x in DATES] == [float(v) for v in VALUES]
    assert rows["2024-06-03"].cash_flow_impact == 3000.0
    assert rows["2024-06-03"].investment_return == pytest.approx(3.851709196, abs=1e-8)
    assert rows["2025-09-02"].portfolio_daily_return == pytest.approx(-5.9461350122, abs=1e-8)


def test_performance(daily, prices):
    row = performance.performance(daily, prices, AS_OF).first().asDict()
    for name, want in PERFORMANCE.items():
        assert row[name] == pytest.approx(want, abs=1e-8), name


def test_monthly_performance_ends_with_the_full_figures(daily):
    last = performance.monthly_performance(daily, AS_OF).orderBy("month_end").collect()[-1]
    assert last.time_weighted_return_pct == pytest.approx(PERFORMANCE["time_weighted_return_pct"], abs=1e-8)
    assert last.sharpe_ratio == pytest.approx(PERFORMANCE["sharpe_ratio"], abs=1e-8)
    assert last.max_drawdown == pytest.approx(PERFORMANCE["max_drawdown"], abs=1e-8)


def test_money_weighted_return(ledger, prices):
    values = holdings.portfolio_value(ledger, prices, AS_OF)
    assert irr.money_weighted_return(ledger, prices, values, AS_OF).first().mwr == pytest.approx(0.0965084319, abs=1e-6)


def test_status(ledger, prices):
    row = status.status(ledger, prices, AS_OF).first().asDict()
    for name, want in STATUS.items():
        assert row[name] == pytest.approx(want, abs=1e-8), name


def test_realized_gain(ledger, prices):
    (row,) = fifo.realized_gains(ledger, prices, AS_OF).collect()
    assert (row.asset, row.sell_quantity, row.cost_basis_usd, row.proceeds_usd, row.realized_gain) == (
        "AAA", 20.0, 2004.0, 2594.0, 590.0,
    )
    assert str(row.matched_buy_date) == "2024-01-02"


def test_rolling_and_period_returns(daily):
    periods = {r.period: r for r in returns.period_returns(daily, AS_OF).collect()}
    assert set(periods) == {"1M", "3M", "6M", "YTD", "1Y", "SII"}
    assert periods["SII"].return_pct == pytest.approx(PERFORMANCE["time_weighted_return_pct"], abs=1e-8)
    rolling = returns.rolling_returns(daily, AS_OF, 12).collect()
    assert min(str(r.date) for r in rolling) == "2025-01-31"
