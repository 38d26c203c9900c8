"""Versioned tables: a failed or repeated write leaves the version before, parts are replaced as wholes."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import sinks, versions
from tests.conftest import d


def incoming(spark, rows):
    return spark.createDataFrame([(t, d(x), p, s) for t, x, p, s in rows], "ticker string, date date, price double, seq long")


def content(spark, path):
    return {(r.ticker, str(r.date)): r.price for r in sinks.read_price_table(spark, path).collect()}


def test_upserts_make_versions(spark, make_prices, tmp_path):
    path = str(tmp_path / "prices")
    assert content(spark, path) == {} and sinks.price_table(spark, path).current().number == 0
    sinks.write_prices(path, make_prices([("A", "2024-01-01", 1), ("A", "2024-02-01", 2)]))
    old = sinks.price_table(spark, path).current()
    sinks.upsert_prices(path, incoming(spark, [("A", "2024-02-01", 5.0, 1), ("A", "2024-02-01", 4.0, 2), ("B", "2024-02-03", 3.0, 1)]), ("w", 0))
    want = {("A", "2024-01-01"): 1.0, ("A", "2024-02-01"): 4.0, ("B", "2024-02-03"): 3.0}
    assert content(spark, path) == want
    new = sinks.price_table(spark, path).current()
    assert new.number == 2 and new.parts["2024-01"] == old.parts["2024-01"] and new.parts["2024-02"] != old.parts["2024-02"]
    # A replayed batch changes nothing; the old version can still be read.
    again = sinks.upsert_prices(path, incoming(spark, [("A", "2024-02-01", 99.0, 1)]), ("w", 0))
    assert again == new and content(spark, path) == want
    assert {r.price for r in sinks.price_table(spark, path).read(old).collect()} == {1.0, 2.0}


def test_a_write_that_fails_half_way_leaves_the_old_version(spark, make_prices, tmp_path):
    path = str(tmp_path / "prices")
    sinks.write_prices(path, make_prices([("A", "2024-01-01", 1)]))
    bad = incoming(spark, [("A", "2024-01-01", 7.0, 1), ("B", "2024-01-02", 0.0, 1)]).withColumn("price", F.when(F.col("ticker") == "B", F.raise_error("torn")).otherwise(F.col("price")))
    with pytest.raises(Exception, match="torn"):
        sinks.upsert_prices(path, bad, ("w", 0))
    assert content(spark, path) == {("A", "2024-01-01"): 1.0}
    sinks.upsert_prices(path, incoming(spark, [("A", "2024-01-01", 7.0, 1)]), ("w", 0))
    assert content(spark, path) == {("A", "2024-01-01"): 7.0}


def test_a_failed_commit_leaves_the_old_version(spark, make_prices, tmp_path, monkeypatch):
    path = str(tmp_path / "prices")
    sinks.write_prices(path, make_prices([("A", "2024-01-01", 1)]))

    def lost(self, version):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(versions.VersionedTable, "_commit", lost)
        with pytest.raises(RuntimeError):
            sinks.upsert_prices(path, incoming(spark, [("A", "2024-01-01", 7.0, 1)]))
    assert content(spark, path) == {("A", "2024-01-01"): 1.0}


def test_the_second_of_two_writers_merges_again(spark, make_prices, tmp_path):
    path = str(tmp_path / "prices")
    table = sinks.price_table(spark, path)
    sinks.write_prices(path, make_prices([("A", "2024-01-01", 1)]))
    since = table.current()
    sinks.upsert_prices(path, incoming(spark, [("B", "2024-01-02", 2.0, 1)]))
    with pytest.raises(versions.Conflict):
        table.write(make_prices([("C", "2024-01-03", 3)]), sinks.month(), ["2024-01"], since)
    calls = []

    def merge(old, new):
        if not calls:
            sinks.upsert_prices(path, incoming(spark, [("D", "2024-01-04", 4.0, 1)]))
        calls.append(1)
        return sinks.merge_prices(old, new)

    table.update(incoming(spark, [("E", "2024-01-05", 5.0, 1)]), sinks.month(), merge)
    assert len(calls) == 2 and {t for t, _ in content(spark, path)} == set("ABDE")


def test_rows_outside_the_replaced_parts_are_refused(spark, make_prices, tmp_path):
    table = sinks.price_table(spark, str(tmp_path / "prices"))
    with pytest.raises(ValueError):
        table.write(make_prices([("C", "2024-01-03", 3)]), sinks.month(), ["2024-02"], table.current())


def test_dated_copies(spark, make_prices, tmp_path, monkeypatch):
    folder = str(tmp_path)
    one, two = make_prices([("A", "2024-01-01", 1)]), make_prices([("A", "2024-01-01", 1), ("B", "2024-01-01", 2)])
    assert sinks.dated_copies({"prices": one, "none": one.where("false")}, folder, "20240101") == {"prices": 1, "none": 0}
    assert sinks.dated_copy(two, folder, "prices", "20240101") == 0
    assert sinks.dated_copy(two, folder, "prices", "20240102") == 2
    assert sinks.read_dated_copy(one, folder, "prices", "20240101").count() == 1
    torn = two.withColumn("price", F.when(F.col("ticker") == "B", F.raise_error("torn")).otherwise(F.col("price")))
    with pytest.raises(Exception, match="torn"):
        sinks.dated_copy(torn, folder, "prices", "20240103")
    assert sinks.dated_copy(two, folder, "prices", "20240103") == 2


def test_documents_replace_their_accounts_only(spark, tmp_path):
    path, schema = str(tmp_path / "documents"), "account string, document string"
    sinks.write_documents(spark.createDataFrame([(f"a{k}", f'{{"v": {k}}}') for k in range(40)], schema), path, 4)
    sinks.write_documents(spark.createDataFrame([("a3", '{"v": "new"}'), ("b", "{}")], schema), path, 4)
    got = {r.account: r.document for r in sinks.document_table(spark, path).read().collect()}
    assert len(got) == 41 and got["a3"] == '{"v": "new"}' and got["a4"] == '{"v": 4}'
