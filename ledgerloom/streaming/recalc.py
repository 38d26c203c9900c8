"""Ledger changes to re-derived daily returns, from the stored state before each change on.

The returns table holds, besides the days of every account, what it held on every month end.  A change dated D re-derives its
account from the last month end before D: positions and adjusted base are read from the table, ledger rows from after
that day only.  Days and states are one table in versions, cut by buckets of accounts, so both change together and a
replayed micro-batch changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions import classify as C
from ledgerloom.operators.asof import clip
from ledgerloom.operators.returns import Opening, daily_returns, month_end_positions, position_spans
from ledgerloom.sources.store import materialize
from ledgerloom.sources.versions import Version, VersionedTable

FIGURES = ("portfolio_value", "portfolio_daily_return", "investment_return", "cash_flow_impact", "adjusted_base")
DAYS = T.StructType([T.StructField("account", T.StringType()), T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in FIGURES]])
STATES = T.StructType(
    [T.StructField("account", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("instrument", T.StringType()),
     T.StructField("date", T.DateType()), T.StructField("quantity", T.DoubleType())]
)
STORED = T.StructType([*DAYS, *[f for f in STATES if f.name not in DAYS.names]])


def earliest_changes(changed: DataFrame) -> DataFrame:
    return changed.groupBy("account").agg(F.min("date").alias("recalc_from"))


def resume_points(since: DataFrame, days: DataFrame) -> DataFrame:
    """(account, recalc_from, resume, adjusted_base): the month end before the change, null where the table has no such day."""
    end = F.last_day(F.add_months("recalc_from", -1))
    known = days.select("account", F.col("date").alias("resume"), "adjusted_base")
    wanted = since.withColumn("_end", end)
    return wanted.join(known, (wanted["account"] == known["account"]) & (F.col("_end") == F.col("resume")), "left").select(
        wanted["account"], "recalc_from", "resume", "adjusted_base"
    )


@dataclass
class Rederived:
    """Days and month-end states from each account's earliest change on, and the ledger rows they were made of."""

    days: DataFrame
    states: DataFrame
    ledger: DataFrame


def rederived(ledger: DataFrame, prices: DataFrame, since: DataFrame, until, unpriced: str, days: DataFrame, states: DataFrame) -> Rederived:
    """``since`` has (account, recalc_from); ``days`` and ``states`` are what is stored for these accounts."""
    points = materialize(resume_points(since, days), "resume-points")
    got = points.agg(F.min("resume").alias("low"), F.count(F.lit(1)).alias("n"), F.count("resume").alias("known")).first()
    # The earliest state bounds the scan, unless an account has none and starts at its first row.
    after = ledger.where(F.col("date") > F.lit(got.low)) if got.n and got.known == got.n else ledger
    rows = after.join(points.select("account", "resume"), "account").where("resume IS NULL OR date > resume").drop("resume")
    resumed = points.where("resume IS NOT NULL").select("account", F.col("resume").alias("date"), "adjusted_base")
    held = states.join(resumed.select("account", "date"), ["account", "date"], "left_semi")
    opening = Opening(held.select("account", "kind", "instrument", "date", "quantity"), resumed)
    new = daily_returns(rows, prices, until, unpriced, opening)
    ends = month_end_positions(position_spans(clip(C.classified(rows), until), until, opening))
    cut = points.select("account", "recalc_from")
    keep = lambda df: df.join(cut, "account").where("date >= recalc_from").drop("recalc_from")
    return Rederived(keep(new), keep(ends), rows)


def rederive(ledger: DataFrame, prices: DataFrame, changed: DataFrame, until, unpriced: str = "refuse") -> DataFrame:
    """Daily returns of the accounts in ``changed`` (account, date), from each one's earliest change on, without stored state."""
    since = earliest_changes(changed)
    affected = ledger.join(since.select("account"), "account", "left_semi")
    daily = daily_returns(affected, prices, until, unpriced)
    return daily.join(since, "account").where("date >= recalc_from").drop("recalc_from")


class ReturnsTable:
    """Days and month-end states of all accounts, in versions."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.table = VersionedTable(spark, path, STORED)

    def _parts(self, what: str, buckets: list[int]) -> list[str]:
        return [f"{what}-{b:06d}" for b in buckets]

    def _part(self):
        bucket = F.lpad(F.pmod(F.xxhash64("account"), F.lit(self.buckets)).cast("string"), 6, "0")
        return F.concat(F.when(F.col("kind").isNull(), F.lit("days-")).otherwise(F.lit("states-")), bucket)

    def days(self, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        return self.table.read(version, self._parts("days", buckets or list(range(self.buckets)))).select(*DAYS.names)

    def states(self, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        return self.table.read(version, self._parts("states", buckets or list(range(self.buckets)))).select(*STATES.names)

    def _write(self, days: DataFrame, states: DataFrame, buckets: list[int], since: Version, batch: tuple[str, int] | None) -> Version:
        rows = days.unionByName(states, allowMissingColumns=True).select(*STORED.names)
        return self.table.write(rows, self._part(), self._parts("days", buckets) + self._parts("states", buckets), since, batch)

    def build(self, ledger: DataFrame, prices: DataFrame, until, unpriced: str = "refuse") -> Version:
        """Derives everything from inception."""
        spans = position_spans(clip(C.classified(ledger), until), until)
        days = daily_returns(ledger, prices, until, unpriced)
        return self._write(days, month_end_positions(spans), list(range(self.buckets)), self.table.current(), None)

    def apply(self, changed: DataFrame, ledger: DataFrame, prices: DataFrame, until, unpriced: str = "refuse", batch: tuple[str, int] | None = None) -> Version:
        """Re-derives what the changes (account, date) touch; ``ledger`` has them applied."""
        version = self.table.current()
        if batch and version.batches.get(batch[0], -1) >= batch[1]:
            return version
        since = materialize(earliest_changes(changed), "changes")
        buckets = [r[0] for r in since.select(F.pmod(F.xxhash64("account"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        if not buckets:
            return version
        days, states = self.days(version, buckets), self.states(version, buckets)
        made = rederived(ledger, prices, since, until, unpriced, days, states)
        old = lambda df: df.join(since, "account", "left").where("recalc_from IS NULL OR date < recalc_from").drop("recalc_from")
        return self._write(old(days).unionByName(made.days), old(states).unionByName(made.states), buckets, version, batch)


def stream_recalculation(
    changes: DataFrame, load_ledger, prices: DataFrame, table: ReturnsTable, checkpoint: str, until, unpriced: str = "refuse"
) -> StreamingQuery:
    """Runs over the changes available and re-derives the accounts they touch in ``table``.

    ``load_ledger`` returns the ledger with the changes applied.
    """

    def recalculate(batch: DataFrame, epoch: int) -> None:
        table.apply(batch.select("account", "date"), load_ledger(), prices, until, unpriced, (checkpoint, epoch))

    return (
        changes.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(recalculate)
        .start()
    )
