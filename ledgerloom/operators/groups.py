"""Ordered scans over groups of any size.

A window puts a whole group into one task.  That is fine for groups bounded by the calendar, not for the rows of
one (account, asset), which may hold a large part of the ledger.  ``split_hot_groups`` cuts such groups into
consecutive blocks; a scan then runs inside the blocks and over one summary row per block.  Groups below the
threshold stay in a single block and pay only a map-side-combined count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1 << 20
BLOCK = ["blk", "sub"]


def split_hot_groups(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``blk`` and ``sub``; (blk, sub) grows with (date, id) inside a group.

    Only groups above ``hot_rows`` are cut: days are packed into blocks of about that many rows, and a single day
    above it is cut further by id range.  ``id`` is unique inside a group, so no block exceeds twice the threshold.
    """
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(*keys)
    per_day = rows.join(hot, keys, "left_semi").groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = per_day.select(
        *keys,
        "date",
        F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / hot_rows).alias("_blk"),
        (F.col("n") > hot_rows).alias("_wide"),
    )
    return (
        rows.join(days, [*keys, "date"], "left")
        .withColumn("blk", F.coalesce("_blk", F.lit(0)).cast("long"))
        .withColumn(
            "sub",
            F.when(F.col("_wide"), F.floor(F.col("id") / hot_rows)).otherwise(F.lit(-1)).cast("long"),
        )
        .drop("_blk", "_wide")
    )


def running_total(
    rows: DataFrame, keys: list[str], value: str, out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each one in (date, id) order."""
    blocked = split_hot_groups(rows, keys, hot_rows)
    inside = Window.partitionBy(*keys, *BLOCK).orderBy("date", "id").rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0.0)))
    block_sums = blocked.groupBy(*keys, *BLOCK).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = block_sums.select(
        *keys, *BLOCK, F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before")
    )
    return (
        local.join(offsets, [*keys, *BLOCK])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_inside", "_before", *BLOCK)
    )
