import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators.returns import daily_returns
from ledgerloom.sources.sinks import read_price_table, write_prices
from ledgerloom.streaming import recalc, ticks
from tests.conftest import d


def at(text):
    return dt.datetime.fromisoformat(text)


TICKS = "ticker string, ts timestamp, value double, event_id long"


def test_ticks_become_upserted_closes(spark, make_prices, tmp_path):
    prices, source, state = (str(tmp_path / n) for n in ("prices", "ticks", "state"))
    write_prices(prices, make_prices([("A", "2024-01-01", 9), ("B", "2024-01-01", 5)]))
    rows = [("A", at("2024-01-01T10:00:00"), 1.0, 1), ("A", at("2024-01-01T20:00:00"), 2.0, 2), ("A", at("2024-01-01T20:00:00"), 2.0, 2),
            ("A", at("2024-01-02T10:00:00"), 3.0, 3), ("A", at("2024-01-03T10:00:00"), 4.0, 4)]
    spark.createDataFrame(rows, TICKS).coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(TICKS).parquet(source)
        ticks.stream_closes_into_prices(stream, prices, state).awaitTermination()
        return {(r.ticker, str(r.date)): r.price for r in read_price_table(spark, prices).collect()}

    # The third day is still open; its last value so far is there.
    assert run() == {("A", "2024-01-01"): 2.0, ("B", "2024-01-01"): 5.0, ("A", "2024-01-02"): 3.0, ("A", "2024-01-03"): 4.0}
    late = [("A", at("2024-01-01T21:00:00"), 99.0, 5), ("A", at("2024-01-04T12:00:00"), 7.0, 6)]
    spark.createDataFrame(late, TICKS).coalesce(1).write.mode("append").parquet(source)
    # The late tick belongs to a closed day and is dropped.
    assert run() == {("A", "2024-01-01"): 2.0, ("B", "2024-01-01"): 5.0, ("A", "2024-01-02"): 3.0, ("A", "2024-01-03"): 4.0, ("A", "2024-01-04"): 7.0}


def rounded(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


CHANGES = "account string, date date"


def test_changes_rederive_from_the_state_before_them(spark, make_ledger, make_prices, tmp_path):
    rows = [("2024-01-02", "USD", "DEPOSIT", 1000), ("2024-01-10", "AAA", "BUY", 10, 20), ("2024-02-05", "AAA", "SPLIT", 2), ("2024-02-20", "AAA", "SELL", 4, 12),
            ("2024-03-11", "USD", "DEPOSIT", 50), ("2024-03-15", "BBB", "BUY", 3, 5), ("2024-04-02", "AAA", "SELL", 2, 13)]
    prices = make_prices([("AAA", "2024-01-01", 20), ("AAA", "2024-02-05", 11), ("AAA", "2024-03-20", 12.5), ("BBB", "2024-01-01", 5), ("BBB", "2024-04-10", 6)])
    before = make_ledger(rows, "one").unionByName(make_ledger(rows, "two")).unionByName(make_ledger(rows[:4], "three"))
    more = [("2024-03-12", "USD", "DEPOSIT", 70), ("2024-03-25", "AAA", "BUY", 2, 12)]
    added = make_ledger(more, "two").withColumn("id", F.col("id") + 100).unionByName(make_ledger([("2024-01-01", "USD", "DEPOSIT", 5)], "three").withColumn("id", F.col("id") + 100))
    after = before.unionByName(added).unionByName(make_ledger([("2024-04-01", "USD", "DEPOSIT", 9)], "new"))
    until = "2024-04-20"
    table = recalc.ReturnsTable(spark, str(tmp_path / "returns"), 3)
    table.build(before, prices, until)
    assert rounded(table.days()) == rounded(daily_returns(before, prices, until).select(*recalc.DAYS.names))
    source, state = str(tmp_path / "changes"), str(tmp_path / "state")
    changes = [("two", d("2024-03-25")), ("two", d("2024-03-12")), ("three", d("2024-01-01")), ("new", d("2024-04-01"))]
    spark.createDataFrame(changes, CHANGES).write.parquet(source)
    stream = lambda: recalc.stream_recalculation(spark.readStream.schema(CHANGES).parquet(source), lambda: after, prices, table, state, until)
    stream().awaitTermination()
    assert rounded(table.days()) == rounded(daily_returns(after, prices, until).select(*recalc.DAYS.names))
    whole = recalc.ReturnsTable(spark, str(tmp_path / "whole"), 3)
    whole.build(after, prices, until)
    assert rounded(table.states()) == rounded(whole.states())
    # A replayed batch leaves the version as it is.
    version = table.table.current()
    assert table.apply(spark.createDataFrame(changes, CHANGES), before, prices, until, batch=(state, 0)) == version
    part = recalc.rederive(after, prices, spark.createDataFrame([("two", d("2024-03-12"))], CHANGES), until)
    assert {(r.account, r.date) for r in part.collect()} == {("two", r.date) for r in table.days().where("account = 'two' AND date >= DATE '2024-03-12'").collect()}


def test_rederivation_reads_ledger_rows_after_the_state_only(spark, make_ledger, make_prices, tmp_path):
    rows = [("2024-01-02", "USD", "DEPOSIT", 1000), ("2024-01-10", "AAA", "BUY", 10, 20), ("2024-03-11", "USD", "DEPOSIT", 50)]
    prices = make_prices([("AAA", "2024-01-01", 20)])
    make_ledger(rows, "one").write.parquet(str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    table = recalc.ReturnsTable(spark, str(tmp_path / "returns"), 2)
    table.build(ledger, prices, "2024-04-20")
    since = spark.createDataFrame([("one", d("2024-03-11"))], "account string, recalc_from date")
    made = recalc.rederived(ledger, prices, since, "2024-04-20", "refuse", table.days(), table.states())
    assert [str(r.date) for r in made.ledger.collect()] == ["2024-03-11"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = made.days._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line and f"{tmp_path}/ledger" in line]
    assert scans and all("GreaterThan(date,2024-02-29)" in line for line in scans)


def test_a_table_without_rows_takes_no_changes(spark, make_ledger, make_prices, tmp_path):
    table = recalc.ReturnsTable(spark, str(tmp_path / "returns"), 2)
    none = make_ledger([])
    table.build(none, make_prices([]), "2024-01-10")
    assert table.days().count() == 0
    table.apply(spark.createDataFrame([], CHANGES), none, make_prices([]), "2024-01-10")
    ledger = make_ledger([("2024-01-02", "USD", "DEPOSIT", 5)], "one")
    table.apply(spark.createDataFrame([("one", d("2024-01-02"))], CHANGES), ledger, make_prices([("AAA", "2024-01-01", 1)]), "2024-01-04")
    assert [r.portfolio_value for r in table.days().collect()] == [5.0] * 3


def test_hourly_closes_keep_late_ticks_apart(spark, tmp_path):
    source, state = str(tmp_path / "ticks"), str(tmp_path / "state")
    table = ticks.CloseTable(spark, str(tmp_path / "closes"))

    def run(rows):
        spark.createDataFrame([(t, at(f"2024-01-01T{x}"), v, i) for t, x, v, i in rows], TICKS).coalesce(1).write.mode("append").parquet(source)
        ticks.stream_hourly_closes(spark.readStream.schema(TICKS).parquet(source), table, state).awaitTermination()
        closes = {(r.ticker, r.window_start.hour): (r.price, r.ticks) for r in table.closes().collect()}
        return closes, sorted((r.ticker, r.event_id, r.price) for r in table.late().collect())

    closes, late = run([("A", "10:00:00", 1.0, 1), ("A", "10:30:00", 2.0, 2), ("A", "10:30:00", 2.0, 2), ("B", "13:59:59", 5.0, 3)])
    assert closes == {("A", 10): (2.0, 2), ("B", 13): (5.0, 1)} and late == []
    # The watermark is at 11:59:59 now: hour 10 is closed, hour 11 still open.  Tick 3 comes once more, tick 4 is late.
    closes, late = run([("A", "10:45:00", 9.0, 4), ("A", "11:10:00", 3.0, 5), ("B", "13:59:59", 5.0, 3), ("B", "13:30:00", 4.0, 6)])
    assert closes == {("A", 10): (2.0, 2), ("A", 11): (3.0, 1), ("B", 13): (5.0, 2)} and late == [("A", 4, 9.0)]
    version = table.table.current()
    replay = spark.createDataFrame([("A", at("2024-01-01T13:00:00"), 9.0, 77)], TICKS)
    assert table.apply(replay, (state, 1)) == version
    closes, late = run([("A", "09:00:00", 8.0, 8), ("A", "10:59:00", 8.5, 9)])
    assert closes[("A", 10)] == (2.0, 2) and late == [("A", 4, 9.0), ("A", 8, 8.0), ("A", 9, 8.5)]
    closes, _ = run([("B", "20:00:00", 6.0, 10)])
    assert closes[("B", 20)] == (6.0, 1) and len(closes) == 4
    # Only ids of open hours are remembered.
    now = table.table.current()
    assert {r.event_id for r in table.table.read(now, ["seen-open"]).collect()} == {10}
