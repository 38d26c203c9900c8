"""Tick stream to closing prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.sinks import upsert_prices
from ledgerloom.sources.store import materialize
from ledgerloom.sources.versions import Version, VersionedTable


def closes(ticks: DataFrame, late: str = "2 hours", every: str = "1 day") -> DataFrame:
    """Last value per ticker and window of a tick stream (ticker, ts, value, event_id).

    Ticks later than ``late`` are dropped by the watermark; ties in time are settled by the event id.  Copies of a tick
    carry its time and event id, so they count once on a stream and on a static frame alike, and never change a price.
    """
    fresh = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    fresh = fresh.dropDuplicates(["event_id", "ts"])
    return (
        fresh.groupBy("ticker", F.window("ts", every).alias("w"))
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"), F.count(F.lit(1)).alias("ticks"))
        .select("ticker", F.col("w.start").alias("window_start"), "price", "ticks")
    )


def stream_closes_into_prices(ticks: DataFrame, prices_path: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Runs the stream over what is available and upserts every day it touched, open ones too: the last write wins.

    The price table keeps the number of the last micro-batch of this checkpoint, so a replayed one changes nothing.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(
            "ticker", F.to_date("window_start").alias("date"), "price", F.lit(epoch).cast("long").alias("seq")
        )
        if not rows.isEmpty():
            upsert_prices(prices_path, rows, (checkpoint, epoch))

    # Copies do not move the last value, so the update stream needs no state for them.
    fresh = ticks.withWatermark("ts", late)
    last = fresh.groupBy("ticker", F.window("ts", "1 day").alias("w")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("price")
    )
    return (
        last.select("ticker", F.col("w.start").alias("window_start"), "price")
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
    )


class CloseTable:
    """Closes of hours that a tick stream keeps up to date, with the ticks that came too late beside them.

    A tick is late when its hour ended at or before the watermark (latest tick of earlier batches less ``delay_s``).  Late ticks
    change no close and are kept as they came.  Copies (one event id) count once as long as their hour is open; the ids
    of closed hours are forgotten, so what is remembered is bounded by the delay.  Closes, late ticks, ids and watermark
    change in one version, so a failed or replayed micro-batch changes nothing.
    """

    STORED = T.StructType(
        [T.StructField("ticker", T.StringType()), T.StructField("window_start", T.TimestampType()), T.StructField("price", T.DoubleType()),
         T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType()), T.StructField("ticks", T.LongType()),
         T.StructField("what", T.StringType()), T.StructField("day", T.StringType())]
    )

    def __init__(self, spark: SparkSession, path: str, delay_s: int = 7200, every_s: int = 3600):
        self.table, self.delay_s, self.every_s = VersionedTable(spark, path, self.STORED), delay_s, every_s

    def _read(self, version: Version, what: str, days: list[str] | None = None) -> DataFrame:
        parts = [p for p in version.parts if p.startswith(f"{what}-") and (days is None or p[len(what) + 1 :] in days)]
        return self.table.read(version, parts)

    def closes(self) -> DataFrame:
        return self._read(self.table.current(), "close").select("ticker", "window_start", "price", "ticks")

    def late(self) -> DataFrame:
        """(ticker, ts, price, event_id, window_start) of ticks that came after their hour was closed."""
        return self._read(self.table.current(), "late").select("ticker", "ts", "price", "event_id", "window_start")

    def apply(self, ticks: DataFrame, batch: tuple[str, int]) -> Version:
        """One micro-batch of (ticker, ts, value, event_id)."""
        since = self.table.current()
        if since.batches.get(batch[0], -1) >= batch[1]:
            return since
        start = F.timestamp_seconds(F.floor(F.unix_micros("ts") / (self.every_s * 1_000_000)) * self.every_s)
        rows = materialize(
            ticks.select("ticker", "ts", F.col("value").alias("price"), F.col("event_id").cast("long"), start.alias("window_start")).withColumn("day", F.date_format("window_start", "yyyyMMdd")),
            "ticks",
        )
        mark = since.marks.get("watermark")
        ends = F.unix_micros("window_start") + self.every_s * 1_000_000
        is_late = F.lit(False) if mark is None else ends <= mark
        seen = self._read(since, "seen")
        fresh = rows.where(~is_late).dropDuplicates(["event_id"]).join(seen.select("event_id"), "event_id", "left_anti")
        last, counted = F.struct("ts", "event_id", "price"), F.count(F.lit(1)).alias("ticks")
        new = fresh.groupBy("ticker", "window_start", "day").agg(F.max(last).alias("last"), counted)
        got = rows.where(~is_late).agg(F.max(F.unix_micros("ts")).alias("m"), F.array_sort(F.collect_set("day")).alias("days")).first()
        if got.m is None and rows.where(is_late).isEmpty():
            return since
        old = self._read(since, "close", got.days)
        both = new.unionByName(old.select("ticker", "window_start", "day", last.alias("last"), "ticks"))
        closes = both.groupBy("ticker", "window_start", "day").agg(F.max("last").alias("last"), F.sum("ticks").alias("ticks")).select(
            "ticker", "window_start", "last.price", "last.ts", "last.event_id", "ticks", F.lit("close").alias("what"), "day"
        )
        now = max(x for x in (mark, None if got.m is None else got.m - self.delay_s * 1_000_000) if x is not None)
        name = f"{batch[1]:09d}"
        ids = seen.select("event_id", "window_start").unionByName(fresh.select("event_id", "window_start")).where(ends > now).select(
            "event_id", "window_start", F.lit("seen").alias("what"), F.lit("open").alias("day")
        )
        late = rows.where(is_late).select("ticker", "window_start", "price", "ts", "event_id", F.lit("late").alias("what"), F.lit(name).alias("day"))
        every = closes.unionByName(ids, allowMissingColumns=True).unionByName(late, allowMissingColumns=True)
        replaced = [f"close-{d}" for d in got.days] + ["seen-open", f"late-{name}"]
        return self.table.write(every, F.concat_ws("-", "what", "day"), replaced, since, batch, {"watermark": now})


def stream_hourly_closes(ticks: DataFrame, table: CloseTable, checkpoint: str) -> StreamingQuery:
    """Runs over the ticks available and brings ``table`` up to date."""
    return (
        ticks.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, epoch: table.apply(batch, (checkpoint, epoch)) and None)
        .start()
    )
