import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import classify as C
from ledgerloom.operators import asof, cash, correlation, exposure, holdings, quality, returns, splits, status

DAY = "2024-06-30"


def positions(ledger, as_of=DAY):
    return {r.asset: r.net_quantity for r in splits.positions(asof.clip(C.classified(ledger), as_of)).collect()}


def test_straddled_and_reverse_split(make_ledger):
    straddle = make_ledger([("2024-01-02", "AAA", "BUY", 10, 1), ("2024-01-03", "AAA", "SPLIT", 2), ("2024-01-04", "AAA", "BUY", 10, 1)])
    assert positions(straddle) == {"AAA": 30.0}
    reverse = make_ledger([("2024-01-02", "AAA", "BUY", 100, 10), ("2024-01-03", "AAA", "SPLIT", 0.1)])
    assert positions(reverse)["AAA"] == pytest.approx(10.0)


def test_split_applies_to_earlier_rows_of_the_same_day_only(make_ledger):
    rows = [("2024-01-02", "AAA", "BUY", 10, 1), ("2024-01-02", "AAA", "SPLIT", 3), ("2024-01-02", "AAA", "BUY", 5, 1)]
    assert positions(make_ledger(rows)) == {"AAA": 35.0}


def mixed(make_ledger, make_prices):
    ledger = make_ledger(
        [
            ("2024-01-02", "USD", "DEPOSIT", 50000),
            ("2024-01-02", "EUR", "DEPOSIT", 5000, None, None, "EUR"),
            ("2024-01-02", "GBPUSD=X", "DEPOSIT", 2000, None, None, "GBP"),
            ("2024-01-03", "AAPL", "BUY", 100, 200, 10, "USD", "USD"),
            ("2024-01-03", "SAP.DE", "BUY", 50, 100, 5, "EUR", "EUR"),
        ]
    )
    prices = make_prices(
        [("AAPL", "2024-01-03", 210), ("SAP.DE", "2024-01-03", 105), ("EURUSD=X", "2024-01-02", 1.12),
         ("GBPUSD=X", "2024-01-02", 1.3)]
    )
    return ledger, prices


def test_currency_mix_and_invariants(make_ledger, make_prices, no_metadata):
    ledger, prices = mixed(make_ledger, make_prices)
    alloc = holdings.allocation(ledger, prices, no_metadata, DAY)
    money = cash.cash(asof.clip(C.classified(ledger), DAY), asof.latest_prices(prices, DAY))
    by_currency = {r.currency: r.usd_value for r in exposure.currency_exposure(alloc, money, DAY).collect()}
    assert by_currency == pytest.approx({"USD": 50990.0, "EUR": 5874.40, "GBP": 2600.0})
    assert {r.cash_key: r.balance for r in money.collect()}["EURUSD=X"] == -5.0
    total = sum(by_currency.values())
    assert sum(r.value_usd for r in alloc.collect()) == pytest.approx(total)
    assert holdings.summary(ledger, prices, DAY).first().portfolio_value_usd == pytest.approx(total)
    assert status.status(ledger, prices, DAY).first().portfolio_value == pytest.approx(total)
    last = returns.daily_returns(ledger, prices, DAY).where(F.col("date") == asof.day(DAY)).first()
    assert last.portfolio_value == pytest.approx(total)


def test_stablecoins_keep_their_own_buckets(make_ledger, make_prices, no_metadata):
    ledger = make_ledger([("2024-01-02", "USDT", "DEPOSIT", 500), ("2024-01-02", "usdc", "DEPOSIT", 250), ("2024-01-03", "CASH USDT", "DEPOSIT", 300)])
    prices = make_prices([("AAA", "2024-01-01", 1)])
    money = cash.cash(asof.clip(C.classified(ledger), DAY), asof.latest_prices(prices, DAY))
    rows = {r.cash_key: r for r in money.collect()}
    assert {k: r.usd_value for k, r in rows.items()} == {"USDT": 800.0, "USDC": 250.0}
    assert rows["USDC"].display_bucket == "CASH USDC"


def test_fee_in_another_currency_is_its_own_leg(make_ledger, make_prices):
    ledger = make_ledger([("2024-01-02", "AAA", "BUY", 1, 100, 0.5, "USD", "BTC"), ("2024-01-03", "AAA", "SELL", 1, 120, 2, "USD", "USD")])
    money = cash.cash(asof.clip(C.classified(ledger), DAY), asof.latest_prices(make_prices([("BTC-USD", "2024-01-01", 1000)]), DAY))
    rows = {r.cash_key: r for r in money.collect()}
    assert rows["USD"].balance == 18.0
    assert (rows["BTC-USD"].balance, rows["BTC-USD"].usd_value, rows["BTC-USD"].display_bucket) == (-0.5, -500.0, "CASH BTC")


def test_guard_names_the_missing_price(make_ledger, make_prices):
    ledger = make_ledger([("2024-01-02", "SAP.DE", "BUY", 1, 100, None, "EUR")])
    with pytest.raises(ValueError, match="SAP.DE"):
        quality.guard_held_prices(ledger, make_prices([("X", "2024-01-01", 1)]), DAY)
    with pytest.raises(ValueError, match="EURUSD=X"):
        quality.guard_held_prices(ledger, make_prices([("SAP.DE", "2024-01-01", 1)]), DAY)
    quality.guard_held_prices(ledger, make_prices([("SAP.DE", "2024-01-01", 1), ("EURUSD=X", "2024-01-01", 1)]), DAY)


def test_asof_with_max_age(make_prices, spark):
    prices = make_prices([("AAA", "2024-01-02", 5), ("AAA", "2024-01-10", 7)])
    probes = spark.createDataFrame([("AAA", x) for x in ("2024-01-01", "2024-01-05", "2024-01-12")], "ticker string, date string").select(
        "ticker", F.to_date("date").alias("date")
    )
    plain = {str(r.date): r.price for r in asof.price_asof(probes, prices, DAY).collect()}
    assert plain == {"2024-01-01": None, "2024-01-05": 5.0, "2024-01-12": 7.0}
    fresh = {str(r.date): r.price for r in asof.price_asof(probes, prices, DAY, max_age_days=2).collect()}
    assert fresh == {"2024-01-01": None, "2024-01-05": None, "2024-01-12": 7.0}


@pytest.mark.parametrize("second,rho", [((20, 22, 21, 24, 23, 26), 1.0), ((1 / 10, 1 / 11, 2 / 21, 1 / 12, 2 / 23, 1 / 13), None)])
def test_correlation(make_ledger, make_prices, no_metadata, second, rho):
    first = (10, 11, 10.5, 12, 11.5, 13)
    prices = make_prices([(t, f"2024-06-{i + 1:02d}", p) for t, row in (("AAA", first), ("BBB", second)) for i, p in enumerate(row)])
    ledger = make_ledger([("2024-06-01", "AAA", "BUY", 1, 1), ("2024-06-01", "BBB", "BUY", 1 if rho else 100, 1), ("2024-06-01", "USD", "DEPOSIT", 2 if rho else 101)])
    matrix = {(r.asset_a, r.asset_b): r.correlation for r in correlation.correlation_matrix(ledger, prices, DAY).collect()}
    assert set(matrix) == {(a, b) for a in ("AAA", "BBB") for b in ("AAA", "BBB")}
    assert matrix[("AAA", "AAA")] == pytest.approx(1.0)
    assert matrix[("AAA", "BBB")] == matrix[("BBB", "AAA")]
    row = correlation.diversification(holdings.allocation(ledger, prices, no_metadata, DAY), prices, DAY).first()
    if rho:
        assert matrix[("AAA", "BBB")] == pytest.approx(1.0)
        assert row.correlation_weighted_hhi == pytest.approx(10000.0)
    else:
        assert matrix[("AAA", "BBB")] < -0.99
        assert row.min_pairwise_correlation == row.max_pairwise_correlation


def test_single_holding_has_no_pair(make_ledger, make_prices, no_metadata):
    prices = make_prices([("AAA", f"2024-06-{i:02d}", 10 + i) for i in range(1, 9)])
    ledger = make_ledger([("2024-06-01", "AAA", "BUY", 1, 1)])
    row = correlation.diversification(holdings.allocation(ledger, prices, no_metadata, DAY), prices, DAY).first()
    assert row.avg_pairwise_correlation is None


def test_rebalance_and_bad_targets(make_ledger, make_prices, no_metadata):
    ledger, prices = mixed(make_ledger, make_prices)
    alloc = holdings.allocation(ledger, prices, no_metadata, DAY)
    rows = {r.asset: r for r in exposure.rebalance(alloc, {"aapl": 50.0, "NEW": 50.0}).collect()}
    by_rank = sorted(rows.values(), key=lambda r: r.drift_rank)
    assert [r.drift_rank for r in by_rank] == list(range(1, len(rows) + 1))
    assert [abs(r.drift_pct) for r in by_rank] == sorted((abs(r.drift_pct) for r in by_rank), reverse=True)
    assert rows["NEW"].action == "BUY" and rows["USD"].action == "SELL"
    assert sum(r.target_value_usd for r in rows.values()) == pytest.approx(59464.4, abs=0.05)
    with pytest.raises(ValueError):
        exposure.rebalance(alloc, {"A": 50.0})


def test_decomposition_of_dividend_growth(make_ledger, make_prices):
    ledger = make_ledger([("2024-01-02", "USD", "DEPOSIT", 1000), ("2024-02-02", "USD", "DIVIDEND", 30)])
    prices = make_prices([("AAA", "2024-01-01", 1)])
    daily = returns.daily_returns(ledger, prices, DAY)
    row = status.decomposition(ledger, prices, daily, DAY).first()
    assert (row.initial_value, row.current_value, row.from_returns_usd, row.total_income) == (1000.0, 1030.0, 0.0, 30.0)


def test_days_without_a_price_are_refused(make_ledger, make_prices):
    ledger = make_ledger([("2024-01-02", "USD", "DEPOSIT", 100), ("2024-01-04", "AAA", "BUY", 1, 10), ("2024-01-05", "BBB", "BUY", 1, 10)])
    prices = make_prices([("AAA", "2024-01-01", 10), ("BBB", "2024-01-07", 10)])
    days = lambda mode: [str(r.date) for r in returns.daily_returns(ledger, prices, "2024-01-08", mode).orderBy("date").collect()]
    assert days("refuse") == ["2024-01-02", "2024-01-03", "2024-01-04"] and len(days("zero")) == 7
    gaps = {(str(r.date), r.unpriced) for r in returns.unpriced_days(ledger, prices, "2024-01-08").collect()}
    assert gaps == {("2024-01-05", 1), ("2024-01-06", 1)}


def test_sector_weights_are_type_checked(spark):
    from ledgerloom.functions.classify import sector_weights_of

    texts = ['[{"sector": "A", "weight": 0.5}, {"sector": 1, "weight": 0.5}, {"sector": "B", "weight": "1"}, 3, null]', "[]", "{}", "junk", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sector_weights_of(F.col("t"))).collect()]
    assert [None if x is None else [tuple(i) for i in x] for x in got][:2] == [[("A", 0.5)], []]
    assert got[3] is None and got[4] is None
