"""Indicators and risk figures against plain loops over one ticker's bars."""

import datetime as dt
import math
import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import indicators, risk
from ledgerloom.schemas import BARS

START = dt.date(2020, 1, 1)


def series(seed, n):
    rng, close, out = random.Random(seed), 100.0, []
    for i in range(n):
        close *= 1 + rng.uniform(-0.03, 0.031)
        out.append((START + dt.timedelta(i), close, close * (1 + rng.random() / 50), close * (1 - rng.random() / 50)))
    return out


def bars(spark, **tickers):
    rows = [(t, x, c, h, lo, c, 1.0) for t, s in tickers.items() for x, c, h, lo in s]
    return spark.createDataFrame(rows, BARS)


@pytest.fixture(scope="module")
def data():
    return {"AAA": series(1, 420), "BBB": series(2, 420), "CCC": series(3, 29), "DDD": series(4, 12)}


@pytest.fixture(scope="module")
def frame(spark, data):
    return bars(spark, **data)


def closes(data, t):
    return [row[1] for row in data[t]]


def loop_rsi(c, period=14):
    if len(c) < period + 1:
        return None
    change = [b - a for a, b in zip(c, c[1:])]
    gain = sum(max(x, 0) for x in change[:period]) / period
    loss = sum(max(-x, 0) for x in change[:period]) / period
    for x in change[period:]:
        gain += (max(x, 0) - gain) / period
        loss += (max(-x, 0) - loss) / period
    return 100 - 100 / (1 + gain / loss)


def loop_macd(c):
    if len(c) < 35:
        return None, None
    fast = slow = c[0]
    signal = 0.0
    for x in c[1:]:
        fast += 2 / 13 * (x - fast)
        slow += 2 / 27 * (x - slow)
        signal += 0.2 * (fast - slow - signal)
    return fast - slow, signal


def loop_stoch_rsi(c):
    if len(c) < 28:
        return None, None
    change = [b - a for a, b in zip(c, c[1:])]
    index = []
    for i in range(13, len(change)):
        part = change[i - 13 : i + 1]
        index.append(100 - 100 / (1 + sum(max(x, 0) for x in part) / sum(max(-x, 0) for x in part)))
    raw = []
    for i in range(13, len(index)):
        part = index[i - 13 : i + 1]
        raw.append((index[i] - min(part)) / (max(part) - min(part)) * 100)
    if len(raw) < 3:
        return None, None
    k = [50.0, 50.0] + [sum(raw[i - 2 : i + 1]) / 3 for i in range(2, len(raw))]
    return k[-1], sum(k[-3:]) / 3


def test_technicals(frame, data):
    rows = {r.ticker: r for r in indicators.technicals(frame).collect()}
    for t, s in data.items():
        c, row = closes(data, t), rows[t]
        assert row.rsi == pytest.approx(loop_rsi(c)), t
        line, signal = loop_macd(c)
        assert row.macd == pytest.approx(line) and row.macd_signal == pytest.approx(signal), t
        k, d = loop_stoch_rsi(c)
        assert row.stochrsi_k == pytest.approx(k) and row.stochrsi_d == pytest.approx(d), t
        if len(c) >= 200:
            assert row.ma200 == pytest.approx(sum(c[-200:]) / 200)
            top, bottom = max(x[2] for x in s[-14:]), min(x[3] for x in s[-14:])
            assert row.williams_r_14 == pytest.approx((top - c[-1]) / (top - bottom) * -100)
    assert rows["DDD"].rsi is None and rows["DDD"].ma_trend == "Insufficient data"
    assert rows["DDD"].stoch_signal == "Insufficient data" and rows["CCC"].macd_trend == "Insufficient data"
    assert rows["CCC"].stochrsi_signal == "Insufficient data"


def test_rsi_series_ends_with_the_last_index(frame, data):
    rows = indicators.rsi_series(frame).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.date):
        last[r.ticker] = r.rsi
    assert set(last) == {"AAA", "BBB", "CCC"}
    for t, value in last.items():
        assert value == pytest.approx(loop_rsi(closes(data, t)))


def test_constant_closes(spark):
    flat = [(START + dt.timedelta(i), 5.0, 5.0, 5.0) for i in range(40)]
    row = indicators.technicals(bars(spark, AAA=flat)).first()
    assert row.rsi == 100.0 and row.williams_r_14 is None and row.williams_r_14_signal == "N/A" and row.stoch_k == 50.0
    types = spark.createDataFrame([("AAA", "STOCK")], "ticker string, type string")
    frame = bars(spark, AAA=flat)
    out = risk.return_risk(risk.returns(frame), risk.with_periods(frame, types)).first()
    assert out.sharpe_ratio is None and out.skewness is None and out.annual_volatility == 0.0


def test_return_risk(spark, frame, data):
    types = spark.createDataFrame([("AAA", "CRYPTO"), ("BBB", "STOCK")], "ticker string, type string")
    rows = {r.ticker: r for r in risk.return_risk(risk.returns(frame), risk.with_periods(frame, types)).collect()}
    for t, periods in (("AAA", 365), ("BBB", 252), ("CCC", 252)):
        c = closes(data, t)
        r = [b / a - 1 for a, b in zip(c, c[1:])]
        n, mean, pop = len(r), st.fmean(r), st.pstdev(r)
        vol = st.stdev(r) * math.sqrt(periods)
        annual = (c[-1] / c[0]) ** (periods / n) - 1
        free = 1.0425 ** (1 / periods) - 1
        down = math.sqrt(sum(min(x - free, 0) ** 2 for x in r) / n) * math.sqrt(periods)
        z = [(x - mean) / pop for x in r]
        assert rows[t].annual_volatility == pytest.approx(vol)
        assert rows[t].sharpe_ratio == pytest.approx((annual - 0.0425) / vol)
        assert rows[t].sortino_ratio == pytest.approx((annual - 0.0425) / down)
        assert rows[t].skewness == pytest.approx(n / ((n - 1) * (n - 2)) * sum(x**3 for x in z))
        assert rows[t].kurtosis == pytest.approx(
            n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * sum(x**4 for x in z) - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
        )


def test_drawdowns_and_benchmark(frame, data):
    rows = {r.ticker: r for r in risk.drawdowns(frame).collect()}
    peak, falls = 0.0, []
    for x, c, *_ in data["AAA"]:
        peak = max(peak, c)
        falls.append(((c - peak) / peak, x))
    assert (rows["AAA"].max_drawdown, rows["AAA"].max_drawdown_date) == (pytest.approx(min(falls)[0]), min(falls)[1])
    assert rows["AAA"].ulcer_index == pytest.approx(math.sqrt(sum((f * 100) ** 2 for f, _ in falls) / len(falls)))
    rets = risk.returns(frame)
    out = {r.ticker: r for r in risk.benchmark_risk(risk.aligned_returns(rets, risk.constant_benchmark(frame, "BBB"))).collect()}
    a = [y / x - 1 for x, y in zip(closes(data, "AAA"), closes(data, "AAA")[1:])]
    b = [y / x - 1 for x, y in zip(closes(data, "BBB"), closes(data, "BBB")[1:])]
    assert out["AAA"].beta == pytest.approx(st.covariance(a, b) / st.variance(b))
    assert out["BBB"].beta == pytest.approx(1.0) and out["BBB"].up_capture == pytest.approx(100.0)
    up = math.prod(1 + x for x, y in zip(a, b) if y > 0) - 1, math.prod(1 + y for y in b if y > 0) - 1
    assert out["AAA"].up_capture == pytest.approx(up[0] / up[1] * 100)


def test_trailing_growth_and_leap_day(spark):
    days = [dt.date(2023, 2, 27), dt.date(2023, 3, 1), dt.date(2024, 2, 29)]
    frame = bars(spark, AAA=[(x, c, c, c) for x, c in zip(days, (100.0, 110.0, 121.0))])
    # A year before 29 February 2024 is 1 March 2023.
    assert risk.cagr(frame, 1).first().cagr_1y == pytest.approx(1.1 ** (1 / (365 / 366)) - 1)
    assert risk.cagr(frame, 3).count() == 0


def test_metric_table_warnings(spark, frame):
    types = spark.createDataFrame([("AAA", "STOCK")], "ticker string, type string")
    index = spark.createDataFrame([(t, "NONE") for t in ("AAA", "BBB", "CCC", "DDD")], "ticker string, index string")
    as_of = START + dt.timedelta(419)
    rows = {r.ticker: r for r in risk.asset_metrics(frame, types, index, as_of, "BBB", lookback_days=500).collect()}
    assert rows["AAA"].warnings == ["TRACKING_ERROR_UNAVAILABLE"]
    assert rows["AAA"].premium_discount is None and 0.0 <= rows["AAA"].fifty_two_week_range_percent <= 100.0
    nav = spark.createDataFrame([("AAA", 80.0)], "ticker string, nav double")
    index = spark.createDataFrame([("AAA", "BBB"), ("BBB", "AAA")], "ticker string, index string")
    more = {r.ticker: r for r in risk.asset_metrics(frame, types, index, as_of, "BBB", lookback_days=500, nav=nav).collect()}
    last = frame.where(F.col("ticker") == "AAA").orderBy(F.desc("date")).first().close
    assert more["AAA"].premium_discount == pytest.approx((last - 80.0) / 80.0 * 100.0)
    assert more["AAA"].tracking_error_benchmark == "BBB" and more["AAA"].tracking_error is not None
    assert "INSUFFICIENT_LOOKBACK_HISTORY" in rows["CCC"].warnings and "INSUFFICIENT_LONG_HISTORY" in rows["CCC"].warnings
    assert rows["AAA"].cagr_1y is not None and rows["AAA"].cagr_3y is None


@pytest.mark.parametrize("block", [1, 3, 7, 256])
def test_blocks_of_bars_smooth_like_one_scan(spark, monkeypatch, block):
    monkeypatch.setattr(indicators, "BLOCK_BARS", block)
    rng = random.Random(block)
    rows, want = [], {}
    for ticker, n in (("A", 60), ("B", 14), ("C", 13), ("D", 1), ("E", 30)):
        closes = [rng.uniform(5, 50) for _ in range(n)]
        rows += [(ticker, k + 1, x) for k, x in enumerate(closes)]
        mean = sum(closes[:14]) / 14 if n >= 14 else None
        for k in range(13, n):
            if k > 13:
                mean += 0.3 * (closes[k] - mean)
            want[ticker, k + 1] = mean
    df = spark.createDataFrame(rows, "ticker string, n long, x double")
    got = {(r.ticker, r.n): r.y for r in indicators.smoothed(df, {"y": ("x", 0.3)}, 14).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_bars_are_counted_over_month_borders(spark):
    days = [dt.date(2024, 1, 30) + dt.timedelta(days=k) for k in (0, 1, 2, 3, 40, 41)]
    df = spark.createDataFrame([("A", x, float(k)) for k, x in enumerate(days)] + [("B", days[4], 9.0)], "ticker string, date date, close double")
    got = sorted(tuple(r) for r in indicators.numbered(df).select("ticker", "n", "close", "before").collect())
    assert got == [("A", k + 1, float(k), float(k - 1) if k else None) for k in range(6)] + [("B", 1, 9.0, None)]
