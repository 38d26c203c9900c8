"""First-in-first-out lot matching without a loop.

Quantities are brought to whole numbers that no split changes, so a lot is an interval on the axis "units bought so far" and a
sale an interval on the axis "units consumed so far"; a sale consumes the lots its interval overlaps.  A sale beyond the
position consumes only what is there.  Both interval ends follow from three running figures (bought, net, lowest net),
so one ordered scan gives them, and the overlaps follow from one sorted sweep.

Each (account, asset) has an axis of its own.  Usual ones have units of ``PLACES`` decimals times the split scale (see
``splits``), in column arithmetic.  Where that would not hold all quantities exactly in 38 digits (many unround splits,
huge or very small quantities), the units are as fine as 38 digits allow: a row's units are computed once with exact
fractions and rounded once, and overlaps of fewer units than the asset has trades, which only such rounding can make,
are no matches.  That is 1e-27 of the turnover for a billion trades.

Hot (account, asset) groups are scanned in blocks (see ``groups``).  Their sweep is cut at the borders of the buy
blocks and sell blocks, so no task sees more than two blocks of rows.  Where no group is hot, plain windows do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import classify as C
from ledgerloom.operators.asof import add_rate, clip, daily_prices, daily_rates, latest_prices, usd_units
from ledgerloom.operators.groups import BLOCK, HOT_ROWS, split_hot_groups
from ledgerloom.operators.splits import KEYS, split_steps, with_split_factor
from ledgerloom.sources.store import materialize

PLACES = 12
UNITS = "decimal(38,0)"
ATOMS = 10**PLACES
#: Digits of the scale and of the whole axis up to which column arithmetic is exact, and of the axis at most.
SCALE_DIGITS, AXIS_DIGITS = 13, 36


def whole_units(quantity, scale):
    """Exact units: the quantity to ``PLACES`` decimals, times its split scale; null where either is beyond 10**12 or 10**13."""
    atoms = (quantity.try_cast(f"decimal(24,{PLACES})") * F.lit(ATOMS).cast("decimal(13,0)")).cast("decimal(24,0)")
    return (atoms * scale.try_cast("decimal(13,0)")).cast(UNITS)


@dataclass
class Axes:
    """What is special about some keys: (account, asset, places, dust, hot), and whether any is hot or has an axis of its own."""

    keys: DataFrame
    hot: bool
    own: bool


def special_axes(trades: DataFrame, steps: DataFrame, hot_rows: int) -> Axes:
    """Keys with many trades, or with quantities or splits that the usual units do not hold exactly; a small written table.

    ``places`` is null for usual units, else the power of ten that makes units as fine as the axis allows; ``dust`` is the
    number of units that rounding can leave over, 0 where nothing is rounded.
    """
    q = F.col("quantity")
    per = trades.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.max(q).alias("most"),
        F.max(q != F.round(q, PLACES)).alias("fine"), F.max(q != F.round(q, 18)).alias("finer"),
    )
    digits = steps.groupBy(*KEYS).agg(F.max("digits").alias("digits"))
    known = per.join(digits, KEYS, "left").withColumn("digits", F.coalesce("digits", F.lit(0.0)))
    top = F.ceil(F.log10("most") + F.log10("n") + F.col("digits"))
    own = F.col("fine") | (F.col("digits") > SCALE_DIGITS - 1) | (F.col("most") >= 1e12) | (top + PLACES > AXIS_DIGITS)
    places = (F.lit(AXIS_DIGITS) - top).cast("int")
    exact = ~F.col("finer") & (places >= 18)
    found = known.select(
        *KEYS, F.when(own, places).alias("places"), F.when(own & ~exact, F.col("n")).otherwise(F.lit(0)).cast(UNITS).alias("dust"),
        (F.col("n") > hot_rows).alias("hot"),
    )
    keys = materialize(found.where("hot OR places IS NOT NULL"), "lot-axes")
    got = keys.agg(F.coalesce(F.max("hot"), F.lit(False)), F.count("places") > 0).first()
    return Axes(keys, got[0], got[1])


@lru_cache(maxsize=1 << 16)
def exact_scale(ratios: tuple[tuple[float, float], ...], before: int) -> int:
    """Numerators of the later splits times denominators of the earlier ones."""
    return prod(int(a) for a, _ in ratios[before:]) * prod(int(b) for _, b in ratios[:before])


def _own_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of the rows whose key has an axis of its own, with exact fractions, rounded once."""
    for batch in batches:
        units, share, end = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("quantity", "places", "ratios", "before")]
        for quantity, places, listed, before in zip(*columns, strict=True):
            ratios = tuple((r["above"], r["below"]) for r in listed or ())
            ten = Fraction(10) ** places
            per_share = exact_scale(ratios, before or 0) * ten
            units.append(round(Fraction(repr(quantity)) * per_share))
            share.append(float(per_share))
            end.append(float(exact_scale(ratios, len(ratios)) * ten))
        made = {"units": pa.array(units, pa.decimal128(38, 0)), "per_share": pa.array(share, pa.float64()), "end_per_share": pa.array(end, pa.float64())}
        kept = [c for c in batch.schema.names if c not in made]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made.values()], names=[*kept, *made])


def unit_trades(clipped: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """Non-cash trades in whole units, in their blocks, and whether any key has more than one block."""
    trades = clipped.where(F.col("action").isin("BUY", "SELL") & ~F.col("cash_like") & (F.col("quantity") > 0))
    steps = split_steps(clipped)
    axes = special_axes(trades, steps, hot_rows)
    # Blocks are assigned first, on the bare rows.
    blocked = split_hot_groups(trades, KEYS, hot_rows) if axes.hot else trades.withColumns({"blk": F.lit(0).cast("long"), "sub": F.lit(-1).cast("long")})
    bare = blocked.select(
        *KEYS, *BLOCK, "as_of", "date", "id", "action", "quantity",
        (F.col("quantity") * F.coalesce("price", F.lit(0.0))).alias("amount"),
        F.coalesce("fees", F.lit(0.0)).alias("fees"),
        "pay_key", "fee_key",
    )
    factored = with_split_factor(bare, steps, more=("ratios", "before"))
    if axes.own:
        own = axes.keys.where("places IS NOT NULL").select(*KEYS, "places", "dust")
        factored = factored.join(own, KEYS, "left").withColumn("dust", F.coalesce("dust", F.lit(0).cast(UNITS)))
    else:
        factored = factored.withColumns({"places": F.lit(None).cast("int"), "dust": F.lit(0).cast(UNITS)})
    usual = factored.where("places IS NULL").withColumns({
        "units": whole_units(F.col("quantity"), F.col("scale")),
        "per_share": F.col("scale") * float(ATOMS), "end_per_share": F.col("end_scale") * float(ATOMS),
    })
    rows = usual
    if axes.own:
        rest = factored.where("places IS NOT NULL")
        schema = T.StructType([*rest.schema, *[usual.schema[c] for c in ("units", "per_share", "end_per_share")]])
        rows = usual.unionByName(rest.mapInArrow(_own_units, schema))
    unused = ("quantity", "factor", "end_factor", "scale", "end_scale", "places", "ratios", "before")
    return rows.drop(*unused).where("units > 0"), axes.hot


def add_costs(rows: DataFrame, prices: DataFrame, until) -> DataFrame:
    """Replaces amounts by ``usd``: lot cost of a buy, net proceeds of a sale, at the rates of the trade's day.

    NULL where the ledger currency has no rate yet.
    """
    daily = daily_rates(prices, until).select("ticker", "date", "price")
    rated = add_rate(add_rate(rows, "pay_key", daily, "pay_rate"), "fee_key", daily, "fee_rate")
    paid, fee = F.col("amount") * F.col("pay_rate"), F.col("fees") * F.col("fee_rate")
    return rated.withColumn("usd", F.when(F.col("action") == "BUY", paid + fee).otherwise(paid - fee)).drop(
        "amount", "fees", "pay_key", "fee_key", "pay_rate", "fee_rate"
    )


def lots(clipped: DataFrame, prices: DataFrame, until, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """Placed and costed trades as a written table, and whether any key has more than one block."""
    rows, hot = unit_trades(clipped, hot_rows)
    return materialize(add_costs(lot_intervals(rows, hot), prices, until), "lots"), hot


def lot_intervals(rows: DataFrame, hot: bool = True) -> DataFrame:
    """Adds [lo, hi) to every trade: its place among all units bought, or among all units consumed.

    Unless something is ``hot``, every key is one block, and nothing comes before it.
    """
    inside = Window.partitionBy(*KEYS, *BLOCK).orderBy("date", "id")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_buy = F.col("action") == "BUY"
    rows = rows.withColumn("signed", F.when(is_buy, F.col("units")).otherwise(-F.col("units")))
    rows = rows.withColumn("net_in", F.sum("signed").over(upto)).withColumn(
        "bought_in", F.sum(F.when(is_buy, F.col("units")).otherwise(F.lit(0).cast(UNITS))).over(upto)
    )
    rows = rows.withColumn(
        "low_before_in", F.min("net_in").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )

    zero = F.lit(0).cast(UNITS)
    if hot:
        rows = rows.join(_before_blocks(rows), [*KEYS, *BLOCK])
    else:
        rows = rows.withColumns({"net_0": zero, "bought_0": zero, "low_0": zero})
    net = F.col("net_0") + F.col("net_in")
    bought = F.col("bought_0") + F.col("bought_in")
    low_before = F.least(F.col("low_0"), F.coalesce(F.col("net_0") + F.col("low_before_in"), zero))
    held_before = net - F.col("signed") - low_before
    held = net - F.least(low_before, net)
    return rows.withColumns(
        {
            "lo": F.when(is_buy, bought - F.col("units")).otherwise(bought - held_before).cast(UNITS),
            "hi": F.when(is_buy, bought).otherwise(bought - held).cast(UNITS),
        }
    ).drop("signed", "net_in", "bought_in", "low_before_in", "net_0", "bought_0", "low_0")


def _before_blocks(rows: DataFrame) -> DataFrame:
    """Net, bought and lowest net units before each block."""
    earlier = Window.partitionBy(*KEYS).orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(UNITS)
    blocks = rows.groupBy(*KEYS, *BLOCK).agg(
        F.sum("signed").alias("net"), F.max("bought_in").alias("bought"), F.min("net_in").alias("low")
    )
    blocks = blocks.select(
        *KEYS, *BLOCK, "low",
        F.coalesce(F.sum("net").over(earlier), zero).alias("net_0"),
        F.coalesce(F.sum("bought").over(earlier), zero).alias("bought_0"),
    )
    return blocks.withColumn(
        "low_0", F.least(zero, F.coalesce(F.min(F.col("net_0") + F.col("low")).over(earlier), zero))
    ).drop("low")


def _sweep(events: DataFrame, group: list[str]) -> DataFrame:
    """Overlaps of two chains of adjoining intervals.

    ``events`` has one row per interval start (``pos``) with the interval in ``buy`` or ``sell`` (``hi`` inside).
    """
    order = Window.partitionBy(*group).orderBy("pos")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    carried = events.select(
        *group,
        F.last("buy", ignorenulls=True).over(upto).alias("buy"),
        F.last("sell", ignorenulls=True).over(upto).alias("sell"),
        F.col("pos").alias("lo"),
        F.lead("pos").over(order).alias("next_pos"),
    )
    return (
        carried.withColumn("hi", F.least("next_pos", "buy.hi", "sell.hi"))
        .where(F.col("buy").isNotNull() & F.col("sell").isNotNull())
        .where(F.col("hi") > F.col("lo"))
        .drop("next_pos")
    )


def _block_overlaps(intervals: DataFrame) -> DataFrame:
    """Stretches of the axis shared by one buy block and one sell block, a row for either side."""
    is_buy = F.col("action") == "BUY"
    blocks = (
        intervals.groupBy(*KEYS, *BLOCK, "action")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .where(F.col("hi") > F.col("lo"))
    )
    block = F.struct("hi", *BLOCK)
    stretches = _sweep(
        blocks.select(
            *KEYS, F.col("lo").alias("pos"), F.when(is_buy, block).alias("buy"), F.when(~is_buy, block).alias("sell")
        ),
        KEYS,
    )
    cell = F.struct(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("buy", "sell") for c in BLOCK])
    sides = F.array(
        *[
            F.struct(F.lit(side.upper()).alias("action"), *[F.col(f"{side}.{c}").alias(c) for c in BLOCK])
            for side in ("buy", "sell")
        ]
    )
    return stretches.select(
        *KEYS, cell.alias("cell"), F.col("lo").alias("cell_lo"), F.col("hi").alias("cell_hi"), F.inline(sides)
    )


def matched_lots(intervals: DataFrame, hot: bool = True) -> DataFrame:
    """One row per (sale, lot) pair: the structs ``sell`` and ``buy`` and the units in common."""
    is_buy = F.col("action") == "BUY"
    what = ["id", "date", "usd", "units", "per_share", "dust", "as_of"]
    if hot:
        placed = intervals.join(_block_overlaps(intervals), [*KEYS, "action", *BLOCK]).where(
            (F.col("lo") < F.col("cell_hi")) & (F.col("hi") > F.col("cell_lo")) & (F.col("hi") > F.col("lo"))
        )
        piece, group = F.struct(F.least("hi", "cell_hi").alias("hi"), *what), [*KEYS, "cell"]
        start = F.greatest("lo", "cell_lo")
    else:
        placed = intervals.where(F.col("hi") > F.col("lo"))
        piece, group, start = F.struct("hi", *what), KEYS, F.col("lo")
    events = placed.select(
        *group, start.alias("pos"), F.when(is_buy, piece).alias("buy"), F.when(~is_buy, piece).alias("sell")
    )
    overlap = F.col("hi") - F.col("lo")
    return _sweep(events, group).select(*KEYS, "buy", "sell", overlap.alias("overlap")).where(F.col("overlap") > F.col("buy.dust"))


def _gain_columns(matches: DataFrame) -> DataFrame:
    def part(side):
        share = F.col(f"{side}.per_share")
        return F.col(f"{side}.usd") * (F.col("overlap").cast("double") / share) / (F.col(f"{side}.units").cast("double") / share)

    proceeds, cost = part("sell"), part("buy")
    return matches.select(
        "account",
        F.col("sell.date").alias("sell_date"),
        F.col("sell.id").alias("sell_id"),
        "asset",
        (F.col("overlap").cast("double") / F.col("sell.per_share")).alias("sell_quantity"),
        proceeds.alias("proceeds_usd"),
        cost.alias("cost_basis_usd"),
        (proceeds - cost).alias("realized_gain"),
        F.datediff("sell.date", "buy.date").alias("holding_days"),
        F.col("buy.id").alias("matched_buy_id"),
        F.col("buy.date").alias("matched_buy_date"),
        F.col("sell.as_of").alias("as_of"),
    )


def realized_gains(
    ledger: DataFrame, prices: DataFrame, to_date, from_date=None, asset: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """A row per sale and lot it consumed.  ``from_date`` filters the output only: lots start at inception."""
    clipped = clip(C.classified(ledger), to_date)
    if asset is not None:
        clipped = clipped.where(F.upper("asset") == asset.upper())
    gains = _gain_columns(matched_lots(*lots(clipped, prices, to_date, hot_rows))).drop("as_of")
    if from_date is not None:
        gains = gains.where(F.col("sell_date") >= F.lit(str(from_date)).cast("date"))
    return gains


def realized_gains_by_year(gains: DataFrame) -> DataFrame:
    """Total, short-term (up to 365 days) and long-term gain per account and year."""
    gain = F.col("realized_gain")
    # Rows of one sale are first folded together, so counting sales needs no distinct over all rows.
    per_sale = gains.groupBy("account", F.year("sell_date").alias("tax_year"), "sell_id").agg(
        F.sum(gain).alias("total"),
        F.sum(F.when(F.col("holding_days") <= 365, gain).otherwise(0.0)).alias("short"),
        F.sum(F.when(F.col("holding_days") > 365, gain).otherwise(0.0)).alias("long"),
    )
    return per_sale.groupBy("account", "tax_year").agg(
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("total_realized_gain"),
        F.coalesce(F.sum("short"), F.lit(0.0)).alias("short_term_gain"),
        F.coalesce(F.sum("long"), F.lit(0.0)).alias("long_term_gain"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


def fifo_metrics(ledger: DataFrame, prices: DataFrame, as_of, until=None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cost basis of open lots, realized and unrealized gain per account, rounded to cents."""
    clipped = clip(C.classified(ledger), as_of)
    last_day = until if isinstance(as_of, DataFrame) else as_of
    intervals, hot = lots(clipped, prices, last_day, hot_rows)
    is_buy = F.col("action") == "BUY"
    bought = intervals.select(
        *KEYS, "as_of",
        F.when(is_buy, F.col("usd")).otherwise(0.0).alias("open_cost"),
        F.lit(0.0).alias("gain"),
        F.when(is_buy, F.col("units")).otherwise(F.col("lo") - F.col("hi")).cast(UNITS).alias("open_units"),
        "end_per_share", "dust",
    )
    sold = _gain_columns(matched_lots(intervals, hot)).select(
        *KEYS, "as_of",
        (-F.col("cost_basis_usd")).alias("open_cost"),
        F.col("realized_gain").alias("gain"),
        F.lit(0).cast(UNITS).alias("open_units"),
        F.lit(None).cast("double").alias("end_per_share"), F.lit(0).cast(UNITS).alias("dust"),
    )
    per_asset = bought.unionByName(sold).groupBy(*KEYS, "as_of").agg(
        F.sum("open_cost").alias("open_cost"),
        F.sum("gain").alias("gain"),
        F.when(F.sum("open_units") > F.max("dust"), F.sum("open_units").cast("double") / F.max("end_per_share")).otherwise(0.0).alias("open_quantity"),
    )
    if isinstance(as_of, DataFrame):
        units = usd_units(daily_prices(prices, until), ("date",)).select(
            F.col("ticker").alias("asset"), F.col("date").alias("as_of"), "unit_usd"
        )
        priced = per_asset.join(units, ["asset", "as_of"], "left")
    else:
        units = usd_units(latest_prices(prices, as_of)).select(F.col("ticker").alias("asset"), "unit_usd")
        priced = per_asset.join(units, "asset", "left")
    zero = F.lit(0.0)
    totals = priced.groupBy("account", "as_of").agg(
        F.round(F.coalesce(F.sum("open_cost"), zero), 2).alias("cost_basis"),
        F.round(F.coalesce(F.sum("gain"), zero), 2).alias("realized_gain"),
        F.round(
            F.coalesce(
                F.sum(F.when(F.col("open_quantity") > 0, F.col("open_quantity") * F.col("unit_usd"))), zero
            ),
            2,
        ).alias("market_value"),
    )
    unrealized = F.col("market_value") - F.col("cost_basis")
    return totals.select(
        "account", "as_of", "cost_basis", "realized_gain",
        unrealized.alias("unrealized_gain"),
        (F.col("realized_gain") + unrealized).alias("total_profit"),
    )
