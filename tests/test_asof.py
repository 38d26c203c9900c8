"""As-of look-ups against a search by hand; no calendar in their plans."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import asof
from tests.conftest import d

START = dt.date(2023, 11, 20)


@pytest.fixture(scope="module")
def quotes_and_points():
    rng = random.Random(3)
    days = [START + dt.timedelta(days=k) for k in range(200)]
    quotes = {(t, x): float(rng.randint(1, 99)) for t in ("A", "B", "EURUSD=X", "SAP.DE") for x in rng.sample(days[5:], 9 if t == "B" else 40)}
    points = [(rng.choice(["A", "A", "A", "B", "C", "SAP.DE", "EURUSD=X"]), rng.choice(days), k) for k in range(400)]
    return quotes, points


def latest(quotes, ticker, day, age=None):
    known = sorted(x for t, x in quotes if t == ticker)
    k = bisect.bisect_right(known, day)
    if not k or age is not None and (day - known[k - 1]).days > age:
        return None
    return quotes[ticker, known[k - 1]]


@pytest.mark.parametrize("age", [None, 0, 3])
def test_latest_quote_is_found(spark, make_prices, quotes_and_points, age):
    quotes, points = quotes_and_points
    until = START + dt.timedelta(days=180)
    prices = make_prices([(t, str(x), p) for (t, x), p in quotes.items()])
    probes = spark.createDataFrame([*points, (None, START, -1)], "ticker string, date date, id int")
    got = {r.id: r.price for r in asof.price_asof(probes, prices, str(until), age).collect()}
    want = {k: latest({q: p for q, p in quotes.items() if q[1] <= until}, t, x, age) if x <= until else None for t, x, k in points}
    assert got == want | {-1: None}


def test_market_values_take_the_rate_of_the_day(spark, make_prices, quotes_and_points):
    quotes, points = quotes_and_points
    prices = make_prices([(t, str(x), p) for (t, x), p in quotes.items()])
    rows = spark.createDataFrame([(t, x, float(k % 7), k) for t, x, k in points], "asset string, date date, quantity double, id int")
    got = {r.id: r.value_usd for r in asof.market_value_usd(rows, prices, "2024-12-31").collect()}
    for t, x, k in points:
        price, rate = latest(quotes, t, x), latest(quotes, "EURUSD=X", x) if t == "SAP.DE" else 1.0
        assert got[k] == (None if price is None or rate is None else pytest.approx(k % 7 * price * rate)), (t, x)


def test_no_calendar_in_the_plan(spark, make_prices):
    prices = make_prices([("A", "2024-01-01", 1)])
    rows = spark.createDataFrame([("A", d("2024-02-01"), 2.0)], "asset string, date date, quantity double")
    for df in (asof.market_value_usd(rows, prices, "2024-12-31"), asof.price_asof(rows.select(F.col("asset").alias("ticker"), "date"), prices, "2024-12-31")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and df.count() == 1


def test_no_quotes_and_no_points(spark, make_prices):
    prices, none = make_prices([]), spark.createDataFrame([], "ticker string, date date")
    assert asof.price_asof(none, make_prices([("A", "2024-01-01", 1)]), "2024-12-31").collect() == []
    one = spark.createDataFrame([("A", d("2024-02-01"))], "ticker string, date date")
    assert [r.price for r in asof.price_asof(one, prices, "2024-12-31").collect()] == [None]
