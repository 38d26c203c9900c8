"""Written tables: the ledger store, and intermediate results whose lineage is cut.

Everything goes to the shared folder the cluster names in ``spark.checkpoint.dir``, so a lost executor re-reads a
table instead of recomputing a long plan, and the planner sees true table sizes when it picks join strategies.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.classify import CLASSES, classified
from ledgerloom.session import checkpoint_folder
from ledgerloom.sources.ledger_views import ledger_views


def _written(df: DataFrame, name: str) -> str:
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and returns a scan of it."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, name))


def classified_by_name(ledger: DataFrame, names: DataFrame) -> DataFrame:
    """``classified``, worked out once for each of the different ``names`` (asset, currency, fee_currency) instead of on every row.

    ``names`` holds at least all that occur in the ledger.
    """
    keys = ("asset", "currency", "fee_currency")
    known = materialize(classified(names.select(*keys).distinct()), "names").alias("n")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return ledger.alias("l").join(known, same, "left").select("l.*", *[f"n.{c}" for c in CLASSES])


class LedgerStore:
    """Transactions, prices, metadata, bars and daily returns of one data folder, each written once per session."""

    _open: dict[tuple[str, str], LedgerStore] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.views = ledger_views(spark, folder, self._keep_trades)
        self._trades = ""

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LedgerStore:
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._open:
            cls._open[key] = cls(spark, folder)
        return cls._open[key]

    def _keep_trades(self, lines: DataFrame, name: str) -> DataFrame:
        """The trade lines are written once, as the ledger's own rows; what is derived from them reads those."""
        rows = classified_by_name(self.views.trade_txn(lines), self.views.trade_names)
        self._trades = _written(rows, name)
        return self.spark.read.schema(rows.schema).parquet(self._trades)

    @cached_property
    def txn(self) -> DataFrame:
        trades, others = self.views.trade_lines, self.views.other_txn()
        rest = _written(classified_by_name(others, others), "other-transactions")
        return self.spark.read.schema(trades.schema).parquet(self._trades, rest)

    prices = cached_property(lambda self: materialize(self.views.prices, "prices"))
    bars = cached_property(lambda self: materialize(self.views.bars, "bars"))
    metadata = cached_property(lambda self: materialize(self.views.metadata, "metadata"))
    macro = cached_property(lambda self: materialize(self.views.macro, "macro"))

    def daily(self, until: str) -> DataFrame:
        """The stored daily-returns table up to ``until``; the mapped quotes have gaps, which count 0 here."""
        from ledgerloom.operators.returns import daily_returns

        tables = self.__dict__.setdefault("_daily", {})
        if until not in tables:
            tables[until] = materialize(daily_returns(self.txn, self.prices, until, "zero"), "daily-returns")
        return tables[until]
