"""Share splits as factor intervals, and split-adjusted positions.

A split applies to the trades of its (account, asset) strictly before it in (date, id) order.  Split rows are few
(corporate actions), so their running products form a small interval table; trades find their interval through an
equi-join on (account, asset), which Spark can broadcast or skew-split.  No window runs over the trades.

Ratios are also kept as fractions, so quantities before and after splits meet on one whole-number axis: a row's
``scale`` is the product of the numerators of later splits and the denominators of earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify as C

KEYS = ["account", "asset"]
MOST_DENOMINATOR, MOST_DECIMALS = 1000, 15
#: Up to this many splits every task gets the whole interval table, and the trades stay where they are.
FEW_SPLITS = 10_000


def denominator(ratio: Column) -> Column:
    """Smallest whole number, up to a thousand, that makes the ratio whole; for other ratios the power of ten of their decimals."""
    fits = F.filter(
        F.sequence(F.lit(1), F.lit(MOST_DENOMINATOR)),
        lambda n: F.abs(ratio * n - F.round(ratio * n)) < F.least(F.lit(1e-9), ratio * n * 1e-9),
    )
    decimals = F.length(F.regexp_extract(ratio.cast("decimal(38,18)").cast("string"), r"\.(\d*?)0*$", 1))
    other = F.pow(F.lit(10.0), F.least(decimals, F.lit(MOST_DECIMALS)))
    return F.coalesce(F.try_element_at(fits, F.lit(1)).cast("double"), other)


def split_steps(ledger: DataFrame) -> DataFrame:
    """Factor intervals per (account, asset): ``factor`` of all splits up to the interval, ``end_factor`` of all.

    ``scale`` and ``end_scale`` are their whole-number counterparts, exact up to 2 ** 53; beyond that ``ratios`` (all splits
    of the key in order, as numerator and denominator) and ``before`` (how many of them come before the interval) give them
    exactly, and ``digits`` bounds their length.  A ratio of zero or less, or none, is no split (the row checks report it).

    The planner cannot know how few splits there are and would shuffle the trades to them, so they are counted first.
    """
    order = Window.partitionBy(*KEYS).orderBy("date", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*KEYS)
    one = F.lit(1.0)
    rows = ledger.where((F.col("action") == "SPLIT") & ~F.col("cash_like") & (F.col("quantity") > 0))
    few = rows.select(F.lit(1)).limit(FEW_SPLITS + 1).count() <= FEW_SPLITS
    splits = (
        rows.select(*KEYS, "date", "id", "quantity", denominator(F.col("quantity")).alias("below"))
        .withColumn("above", F.round(F.col("quantity") * F.col("below")))
        .select(
            *KEYS,
            "date",
            "id",
            F.product(F.col("above") / F.col("below")).over(upto).alias("factor"),
            F.product(F.col("above") / F.col("below")).over(whole).alias("end_factor"),
            F.lead("date").over(order).alias("to_date"),
            F.lead("id").over(order).alias("to_id"),
            F.row_number().over(order).alias("n"),
            (F.coalesce(F.product("above").over(later), one) * F.product("below").over(upto)).alias("scale"),
            F.product("below").over(whole).alias("end_scale"),
            F.product("above").over(whole).alias("first_scale"),
            F.collect_list(F.struct("above", "below")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("ratios"),
            F.sum(F.log10(F.greatest("above", "below"))).over(whole).alias("digits"),
        )
    )
    # The first split of a key also opens the interval before it.
    before = F.struct(
        F.lit("0001-01-01").cast("date").alias("from_date"), F.lit(-1).cast("long").alias("from_id"),
        F.col("date").alias("to_date"), F.col("id").alias("to_id"), F.lit(1.0).alias("factor"),
        F.col("first_scale").alias("scale"), F.lit(0).alias("before"),
    )
    after = F.struct(
        F.col("date").alias("from_date"), F.col("id").alias("from_id"), "to_date", "to_id", "factor", "scale", F.col("n").alias("before")
    )
    steps = splits.select(
        *KEYS, "end_factor", "end_scale", "ratios", "digits", F.inline(F.when(F.col("n") == 1, F.array(before, after)).otherwise(F.array(after)))
    )
    return F.broadcast(steps) if few else steps


def with_split_factor(rows: DataFrame, steps: DataFrame, asset: str = "asset", only: str = "true", more: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``factor`` (splits before the row), ``end_factor`` (all splits), and their scales; 1 where there are none.

    ``asset`` names the column that holds the asset, ``only`` a condition on the rows (``t``) that splits apply to, ``more``
    further columns of ``steps``, null where there are no splits.
    """
    t, s = rows.alias("t"), steps.alias("s")
    same = F.expr(f"t.account = s.account AND t.{asset} = s.asset AND {only}")
    started = F.expr("t.date > s.from_date OR (t.date = s.from_date AND t.id > s.from_id)")
    open_end = F.expr("s.to_date IS NULL OR t.date < s.to_date OR (t.date = s.to_date AND t.id < s.to_id)")
    return t.join(s, same & started & open_end, "left").select(
        "t.*",
        F.coalesce("s.factor", F.lit(1.0)).alias("factor"),
        F.coalesce("s.end_factor", F.lit(1.0)).alias("end_factor"),
        F.coalesce("s.scale", F.lit(1.0)).alias("scale"),
        F.coalesce("s.end_scale", F.lit(1.0)).alias("end_scale"),
        *[F.col(f"s.{c}") for c in more],
    )


def positions(clipped: DataFrame) -> DataFrame:
    """Split-adjusted net quantity per (account, asset); zero positions are dropped.

    ``clipped`` is a classified ledger with its ``as_of`` column.
    """
    held = clipped.where(~F.col("cash_like") & (F.col("action") != "SPLIT")).select(
        "account", "as_of", "asset", "asset_type", "date", "id",
        C.position_delta(F.col("action"), F.col("quantity")).alias("delta"),
    )
    adjusted = with_split_factor(held, split_steps(clipped))
    return (
        adjusted.groupBy("account", "as_of", "asset", "asset_type")
        .agg(F.sum(F.col("delta") * F.try_divide("end_factor", "factor")).alias("net_quantity"))
        .where("net_quantity <> 0")
    )
