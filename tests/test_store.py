import datetime as dt

from ledgerloom.functions.classify import classified
from ledgerloom.sources.ledger_views import ledger_views
from ledgerloom.sources.store import LedgerStore


def _tables(spark, folder):
    line = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    )
    order = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    priorities = ("1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    lines, orders = [], []
    for key in range(1, 41):
        day = dt.datetime(1997, 1, 1) + dt.timedelta(days=key * 9)
        orders.append((key, None if key == 5 else key * 7, "O", 1000.0 + key, day, priorities[key % 4]))
        for n in range(1, 8):
            part = None if key == 3 and n == 1 else key * 5 + n
            lines.append((key, part, 1, n, float(n), 10.0, 0.05, 0.02 * (n % 3), "R" if n == 4 else "N", "O", day))
    lines += [lines[10], lines[20], (99, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", dt.datetime(1997, 5, 5))]
    spark.createDataFrame(lines, line).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([*orders, orders[7]], order).write.parquet(f"{folder}/orders.parquet")


def test_trades_are_written_once_and_classified_by_name(spark, tmp_path):
    _tables(spark, tmp_path)
    store = LedgerStore(spark, str(tmp_path))
    wanted = classified(ledger_views(spark, str(tmp_path)).txn)
    assert store.txn.columns == wanted.columns
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(store.txn.collect(), key=key) == sorted(wanted.collect(), key=key)
    assert store.txn.where("action = 'SPLIT'").count() > 0
    # The ledger reads the files of the trade lines themselves, not a second copy of them.
    assert set(store.views.trade_lines.inputFiles()) <= set(store.txn.inputFiles())
