import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import changes, quality
from ledgerloom.schemas import METADATA, TRANSACTIONS
from ledgerloom.sources import readers, sinks
from tests.conftest import d


def errors(spark, **row):
    base = {"account": "a", "id": 1, "date": d("2024-01-02"), "asset": "AAPL", "action": "BUY", "quantity": 1.0, "price": 2.0,
            "currency": "USD", "fees": None, "fee_currency": None, "exchange": "X", "exchange_group_id": None}
    rows = spark.createDataFrame([tuple({**base, **row}[f.name] for f in TRANSACTIONS)], TRANSACTIONS)
    return quality.validate_rows(rows).first().errors


@pytest.mark.parametrize(
    "row,code",
    [
        ({}, None),
        ({"action": "GIFT"}, "UNKNOWN_ACTION"),
        ({"asset": " "}, "ASSET_REQUIRED"),
        ({"asset": "EUR"}, "BARE_CURRENCY_TRADE"),
        ({"currency": "XXX"}, "UNKNOWN_CURRENCY"),
        ({"exchange": None}, "EXCHANGE_REQUIRED"),
        ({"quantity": 0.0}, "QUANTITY_NOT_POSITIVE"),
        ({"price": None}, "PRICE_REQUIRED"),
        ({"fees": -1.0}, "FEES_NEGATIVE"),
        ({"action": "DIVIDEND", "asset": "USD"}, "PRICE_NOT_ALLOWED"),
        ({"action": "FEE", "asset": "AAPL", "price": None}, "CASH_ASSET_REQUIRED"),
        ({"action": "FEE", "asset": "CASH USD", "price": None}, None),
        ({"action": "TRANSFER", "account": None, "price": None}, "ACCOUNT_REQUIRED"),
    ],
)
def test_row_rules(spark, row, code):
    assert errors(spark, **row) == ([] if code is None else [code])


def test_holiday_is_not_required_but_a_gap_is(make_ledger, make_prices):
    ledger = make_ledger(
        [("2026-06-17", "AAPL", "BUY", 1, 1), ("2026-06-19", "AAPL", "BUY", 1, 1), ("2026-06-19", "SAP.DE", "BUY", 1, 1, None, "EUR")]
    )
    prices = make_prices(
        [("MSFT", "2026-06-17", 1), ("AAPL", "2026-06-18", 1), ("SAP.DE", "2026-06-19", 1), ("EURUSD=X", "2026-06-19", 1.1)]
    )
    points = {(r.ticker, str(r.checkpoint_date)) for r in quality.required_checkpoints(ledger, prices, "2026-06-19").collect()}
    assert points == {("AAPL", "2026-06-17"), ("AAPL", "2026-06-18"), ("SAP.DE", "2026-06-19"), ("EURUSD=X", "2026-06-19")}
    missing = quality.missing_checkpoints(quality.required_checkpoints(ledger, prices, "2026-06-19"), prices)
    (row,) = quality.coverage_issues(missing).collect()
    assert (row.ticker, row.issues) == ("AAPL", "missing_dates: 2026-06-17")
    stale = quality.stale_tickers(quality.required_tickers(ledger), prices, "2026-06-21", 2).collect()
    assert [(r.ticker, r.age_days) for r in stale] == [("AAPL", 3)]
    report = {r.ticker: r for r in quality.price_report(ledger, prices, "2026-06-21", 2).collect()}
    assert (report["AAPL"].missing_dates, report["AAPL"].stale, report["AAPL"].age_days) == ("2026-06-17", True, 3)
    assert "MSFT" not in report and not report["SAP.DE"].stale
    plan = {r.ticker: (r.plan, r.status) for r in quality.repair_plan(ledger, prices, "2026-06-21", 2).collect()}
    assert plan["AAPL"] == ("repair", "degraded") and plan["SAP.DE"][0] == "skip_fresh"
    run = quality.repair_summary(ledger, prices, "2026-06-21", 2).first()
    assert (run.status, run.unresolved_stale, str(run.range_end)) == ("degraded", 1, "2026-06-21")
    chosen = quality.repair_summary(ledger, prices, "2026-06-21", 2, tickers=["SAP.DE"], start="2026-06-01").first()
    assert (chosen.status, chosen.would_skip_fresh, str(chosen.range_start)) == ("ok", 1, "2026-06-01")
    fresh = quality.freshness(ledger, prices, "2026-06-19").first()
    assert fresh.stale and fresh.price_age_days == 0
    never = quality.missing_or_stale(quality.required_tickers(make_ledger([("2026-06-17", "NEW", "BUY", 1, 1)])), prices, "2026-06-19")
    assert [r.ticker for r in never.collect()] == ["NEW"]


def test_exchange_requests(spark):
    requests = spark.createDataFrame(
        [("a", 10, d("2024-01-02"), "USD", "EUR", 100.0, 0.9), ("a", 20, d("2024-01-02"), "EUR", "EURUSD=X", 1.0, 1.0),
         ("a", 30, d("2024-01-02"), "AAPL", "EUR", 1.0, -1.0)],
        "account string, id long, date date, from_asset string, to_asset string, quantity double, rate double",
    )
    bad = {r.id: r.errors for r in changes.check_exchanges(requests).collect()}
    assert bad == {10: [], 20: ["SAME_ASSET"], 30: ["RATE_NOT_POSITIVE", "FROM_NOT_CASH"]}
    legs = {r.action: r for r in changes.exchange_legs(requests).collect()}
    assert (legs["EXCHANGE_FROM"].quantity, legs["EXCHANGE_TO"].quantity) == (-100.0, 90.0)
    assert legs["EXCHANGE_FROM"].exchange_group_id == legs["EXCHANGE_TO"].exchange_group_id


def test_change_batch(spark, make_ledger):
    ledger = make_ledger([("2024-01-02", "AAA", "BUY", 10, 1), ("2024-02-02", "USD", "EXCHANGE_FROM", -5), ("2024-02-02", "EUR", "EXCHANGE_TO", 4),
                          ("2024-03-02", "USD", "EXCHANGE_FROM", -1), ("2024-04-02", "AAA", "BUY", 3, 1)])
    ledger = ledger.withColumn("exchange_group_id", F.when(F.col("id").isin(2, 3), F.lit("g")))
    edits = spark.createDataFrame([("main", 5, d("2024-01-20"), 7.0)], "account string, id long, date date, quantity double")
    deletes = spark.createDataFrame([("main", 3), ("main", 4), ("main", 99)], "account string, id long")
    extra = changes.split_rows(spark.createDataFrame([("main", 50, d("2024-05-01"), " aaa ", 2.0), ("main", 51, d("2024-05-01"), "USD", 2.0)],
                                                     "account string, id long, date date, asset string, ratio double"))
    refused = {r.id: r.refused for r in changes.resolved_deletes(ledger, deletes).collect()}
    assert refused == {2: False, 3: False, 4: True}
    after, since = changes.apply_changes(ledger, edits, deletes, extra)
    rows = {r.id: r for r in after.collect()}
    assert set(rows) == {1, 4, 5, 50}
    assert (rows[5].quantity, str(rows[5].date), rows[5].price) == (7.0, "2024-01-20", 1.0)
    assert rows[50].asset == "AAA" and rows[50].action == "SPLIT"
    assert [str(r.recalc_from) for r in since.collect()] == ["2024-01-20"]


def test_price_upsert_rewrites_only_touched_months(spark, make_prices, tmp_path):
    path = str(tmp_path / "prices")
    sinks.write_prices(path, make_prices([("A", "2024-01-05", 1), ("A", "2024-02-05", 2)]))
    untouched = sinks.price_table(spark, path).current().parts["2024-01"]
    new = make_prices([("A", "2024-02-05", 5), ("A", "2024-02-05", 6), ("B", "2024-02-06", 7)])
    sinks.upsert_prices(path, new.withColumn("seq", F.col("price").cast("long")))
    got = {(r.ticker, str(r.date)): r.price for r in sinks.read_price_table(spark, path).collect()}
    assert got == {("A", "2024-01-05"): 1.0, ("A", "2024-02-05"): 6.0, ("B", "2024-02-06"): 7.0}
    assert sinks.price_table(spark, path).current().parts["2024-01"] == untouched


def test_metadata_upserts_replace_only_their_columns(spark):
    def meta(**v):
        return tuple(v.get(f.name) for f in METADATA)

    now = dt.datetime(2024, 1, 1)
    current = spark.createDataFrame([meta(ticker="A", quote_type="ETF", sector="Old", fetched_at=now)], METADATA)
    profile = spark.createDataFrame([meta(ticker="A", region="US"), meta(ticker="B", sector="New")], METADATA)
    rows = {r.ticker: r for r in sinks.merge_metadata(current, profile, sinks.PROFILE_COLUMNS).collect()}
    assert (rows["A"].quote_type, rows["A"].sector, rows["A"].region) == ("ETF", None, "US")
    assert rows["B"].sector == "New" and rows["B"].quote_type is None


def test_snapshots_are_written_once(spark, make_prices, tmp_path):
    table = make_prices([("A", "2024-01-05", 1)])
    assert sinks.dated_copy(table, str(tmp_path), "prices", "20240105") == table.count()
    assert sinks.dated_copy(table.union(table), str(tmp_path), "prices", "20240105") == 0
    assert sinks.read_dated_copy(table, str(tmp_path), "prices", "20240105").count() == 1


def test_indicator_file_takes_the_last_non_blank(spark, tmp_path):
    path = tmp_path / "rate.csv"
    path.write_text("observation_date,OTHER,UNRATE\n2024-01-01,1,3.7\n2024-02-01,2,3.9\n2024-03-01,3, \n2024-04-01,4,\n")
    row = readers.latest_value(readers.read_indicator(spark, str(path), "observation_date", "UNRATE")).first()
    assert (row.value, str(row.date)) == (3.9, "2024-02-01")


def test_the_guard_stops_a_run_and_names_the_ticker(make_ledger, make_prices):
    ledger = make_ledger([("2024-01-02", "AAA", "BUY", 1, 5), ("2024-01-03", "SAP.DE", "BUY", 2, 6), ("2024-01-04", "GONE", "BUY", 3, 7), ("2024-01-05", "GONE", "SELL", 3, 7)])
    with pytest.raises(ValueError, match="PRICE_UNAVAILABLE: AAA as of 2024-01-10"):
        quality.guard_held_prices(ledger, make_prices([("SAP.DE", "2024-01-02", 5), ("EURUSD=X", "2024-01-02", 1)]), "2024-01-10")
    with pytest.raises(ValueError, match="FX_PRICE_UNAVAILABLE: EURUSD=X"):
        quality.guard_held_prices(ledger, make_prices([("AAA", "2024-01-02", 5), ("SAP.DE", "2024-01-02", 5)]), "2024-01-10")
    # Sold assets need no price; nor does anything before it is bought.
    quality.guard_held_prices(ledger, make_prices([("AAA", "2024-01-02", 5), ("SAP.DE", "2024-01-02", 5), ("EURUSD=X", "2024-01-02", 1)]), "2024-01-10")
    quality.guard_held_prices(ledger, make_prices([]), "2024-01-01")


def test_metadata_upsert_takes_every_text_column(spark):
    text = [f.name for f in METADATA if f.dataType.simpleString() == "string" and f.name != "ticker"]
    schema = "ticker string, " + ", ".join(f"{c} string" for c in text)
    old = spark.createDataFrame([("A", *["old"] * len(text)), ("B", *["kept"] * len(text))], schema)
    new = spark.createDataFrame([("A", *["new"] * len(text)), ("C", *[None] * len(text))], schema)
    got = {r.ticker: tuple(r)[1:] for r in sinks.merge_metadata(old, new, tuple(text)).collect()}
    assert got == {"A": ("new",) * len(text), "B": ("kept",) * len(text), "C": (None,) * len(text)}
    for column in text:
        one = {r.ticker: r.asDict() for r in sinks.merge_metadata(old, new.select("ticker", column), (column,)).collect()}
        assert one["A"] == {"ticker": "A"} | {c: "new" if c == column else "old" for c in text}
