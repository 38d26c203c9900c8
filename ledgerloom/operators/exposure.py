"""Exposure, concentration and target comparison over an allocation.

An allocation has one row per (account, asset), so windows over an account are bounded by the assets it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions import classify as C
from ledgerloom.functions.stats import pct_of_positive, ratio
from ledgerloom.operators.asof import day
from ledgerloom.sources.store import materialize

CASH_TYPES = ("cash_base", "cash_fx", "cash_stable")


def currency_exposure(alloc: DataFrame, cash: DataFrame, as_of) -> DataFrame:
    """Holdings and cash per currency.  Both sides are stacked and summed, which is a full outer join by key."""
    held = alloc.where(~F.col("asset_type").isin(*CASH_TYPES)).select(
        "account",
        C.cash_display_currency(C.quote_currency_pair(F.col("asset_type"))).alias("currency"),
        F.col("value_usd").alias("holdings_usd"), F.lit(0.0).alias("cash_usd"),
    )
    money = cash.where("usd_value <> 0").select(
        "account", "currency", F.lit(0.0).alias("holdings_usd"), F.col("usd_value").alias("cash_usd")
    )
    both = held.unionByName(money).groupBy("account", "currency").agg(
        F.sum("holdings_usd").alias("holdings_usd"), F.sum("cash_usd").alias("cash_usd")
    )
    usd = F.col("holdings_usd") + F.col("cash_usd")
    both = both.withColumn("usd_value", usd)
    total = F.sum("usd_value").over(Window.partitionBy("account"))
    return both.withColumn("portfolio_value", total).where("usd_value <> 0").select(
        "account", day(as_of).alias("as_of_date"), "portfolio_value", "currency", "usd_value",
        pct_of_positive(F.col("usd_value"), F.col("portfolio_value")).alias("pct"),
        "holdings_usd", "cash_usd",
    )


def concentration(alloc: DataFrame) -> DataFrame:
    """Herfindahl index (0..10000) and number of holdings per account."""
    return alloc.groupBy("account").agg(
        (F.sum(F.pow(F.col("allocation_pct") / 100.0, 2)) * 10000.0).alias("hhi"),
        F.count(F.lit(1)).alias("total_holdings"),
    )


def top_holdings(alloc: DataFrame, n: int = 5) -> DataFrame:
    """Largest holdings of each account."""
    best = Window.partitionBy("account").orderBy(F.col("allocation_pct").desc(), "asset", "asset_type")
    return (
        alloc.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
        .select("account", "rank", "asset", "asset_type", "allocation_pct")
    )


def largest_holdings(alloc: DataFrame, n: int) -> DataFrame:
    """Largest holdings over all accounts (a top-k, never a full sort)."""
    return alloc.orderBy(F.col("value_usd").desc(), "account", "asset", "asset_type").limit(n).select(
        "account", "asset", "value_usd", "allocation_pct"
    )


def kind_exposure(alloc: DataFrame) -> DataFrame:
    return (
        alloc.where("allocation_pct > 0")
        .groupBy("account", "asset_kind")
        .agg(F.sum("allocation_pct").alias("allocation_pct"))
    )


def holdings_table(alloc: DataFrame) -> DataFrame:
    """Rows worth showing: at least 0.05 percent either way, neither cash nor currency, largest first."""
    order = Window.partitionBy("account").orderBy(F.col("value_usd").desc(), "asset")
    shown = alloc.where((F.abs("allocation_pct") >= 0.05) & ~F.col("asset_kind").isin("cash", "fx"))
    return shown.select(
        "account", "asset", "asset_kind", "net_quantity", "value_usd", "allocation_pct",
        F.row_number().over(order).alias("position"),
    )


def add_sectors(alloc: DataFrame, metadata: DataFrame) -> DataFrame:
    """Sector and sector weights of each holding: metadata first, name-based fallback where it has neither."""
    meta = metadata.select(F.col("ticker").alias("asset"), "sector", "sector_weights")
    rows = alloc.join(meta, "asset", "left")
    known = (F.coalesce("sector", F.lit("")) != "") | (F.coalesce(F.size("sector_weights"), F.lit(0)) > 0)
    asset = F.col("asset")
    return rows.withColumns(
        {
            "sector": F.coalesce(
                "sector", F.when(~known, C.fallback_sector(asset, F.col("asset_kind")))
            ),
            "sector_weights": F.coalesce(
                "sector_weights", F.when(~known, C.fallback_sector_weights(asset))
            ),
        }
    )


def sector_exposure(enriched: DataFrame, min_pct: float = 3.0, top_n: int = 8) -> DataFrame:
    """Equity value per sector; small sectors and those beyond the largest ``top_n`` fold into "Other"."""
    value = F.col("value_usd")
    rows = enriched.where(~F.col("asset_kind").isin(*vocab.NON_EQUITY_KINDS) & (value > 0))
    usable = F.filter("sector_weights", lambda w: w["sector"].isNotNull() & (w["sector"] != "") & (w["weight"] > 0))
    rows = rows.withColumn("weights", usable).withColumn(
        "as_pct", F.exists("weights", lambda w: w["weight"] > 1.0)
    )
    scale = F.when(F.col("as_pct"), F.lit(100.0)).otherwise(F.lit(1.0))

    def slice_of(sector, amount):
        return F.struct(sector.alias("sector"), amount.alias("value"))

    pieces = F.transform("weights", lambda w: slice_of(w["sector"], value * (w["weight"] / scale)))
    assigned = F.aggregate(pieces, F.lit(0.0), lambda acc, p: acc + p["value"])
    rest = F.greatest(F.lit(0.0), value - assigned)
    with_rest = F.when(
        rest > 0.005, F.concat(pieces, F.array(slice_of(F.lit("Other"), rest)))
    ).otherwise(pieces)
    has_weights = F.coalesce(F.size("sector_weights"), F.lit(0)) > 0
    slices = (
        F.when(has_weights & (F.size("weights") > 0), with_rest)
        .when(has_weights, F.array(slice_of(F.lit("Other"), value)))
        .otherwise(F.array(slice_of(F.coalesce(F.nullif("sector", F.lit("")), F.lit("Other")), value)))
    )
    by_sector = (
        rows.select("account", F.inline(slices))
        .where(~F.col("sector").isin(*vocab.NON_EQUITY_SECTORS) & (F.col("value") > 0))
        .groupBy("account", "sector")
        .agg(F.sum("value").alias("value"))
    )
    ranked = by_sector.withColumn("total", F.sum("value").over(Window.partitionBy("account")))
    small = (F.col("sector") == "Other") | (F.col("value") / F.col("total") * 100.0 < min_pct)
    order = Window.partitionBy("account", "small").orderBy(F.col("value").desc(), "sector")
    ranked = ranked.withColumn("small", small).withColumn("rank", F.row_number().over(order))
    folded = F.when(F.col("small") | (F.col("rank") > top_n), F.lit("Other")).otherwise(F.col("sector"))
    return (
        ranked.groupBy("account", folded.alias("sector"))
        .agg(F.sum("value").alias("value_usd"), F.max("total").alias("total"))
        .select("account", "sector", "value_usd", (F.col("value_usd") / F.col("total") * 100.0).alias("pct"))
    )


def rebalance(alloc: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Drift of every account from target percentages that sum to 100; rank 1 is an account's largest drift.

    Targets are exploded onto each account's row and stacked with its holdings, so no join is needed.
    """
    total = sum(targets.values())
    if abs(total - 100.0) > 0.01:
        raise ValueError(f"targets sum to {total}, expected 100")
    alloc = materialize(alloc.select("account", "asset", "allocation_pct", "value_usd"), "allocation")
    accounts = alloc.groupBy("account").agg(F.sum("value_usd").alias("total"))
    wanted = accounts.select(
        "account", "total",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a.upper()).alias("asset"), F.lit(float(p)).alias("target_pct"))
                    for a, p in targets.items()
                ]
            )
        ),
    )
    none = F.lit(0.0)
    held = alloc.select(
        "account", none.alias("total"), "asset", none.alias("target_pct"),
        F.col("allocation_pct").alias("current_pct"), F.col("value_usd").alias("current_value"),
    )
    wanted = wanted.withColumn("current_pct", none).withColumn("current_value", none)
    rows = wanted.unionByName(held).groupBy("account", "asset").agg(
        *[F.sum(c).alias(c) for c in ("target_pct", "current_pct", "current_value")]
    )
    rows = rows.join(accounts, "account")
    drift = F.col("current_pct") - F.col("target_pct")
    target_value = F.col("target_pct") / 100.0 * F.col("total")
    delta = target_value - F.col("current_value")
    return rows.select(
        "account", "asset",
        F.round("current_pct", 2).alias("current_pct"), "target_pct", F.round(drift, 2).alias("drift_pct"),
        F.round("current_value", 2).alias("current_value_usd"), F.round(target_value, 2).alias("target_value_usd"),
        F.round(delta, 2).alias("suggested_delta_usd"),
        F.when(F.abs(drift) < 0.01, "HOLD").when(delta > 0, "BUY").otherwise("SELL").alias("action"),
    ).withColumn("drift_rank", F.row_number().over(Window.partitionBy("account").orderBy(F.abs("drift_pct").desc(), "asset")))


def day_change(alloc: DataFrame, prices: DataFrame, as_of) -> DataFrame:
    """Last and previous price of each holding and the gain since the previous one.

    The previous price is the latest before the last; both come from one grouped pass that keeps two quotes.
    """
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    two = (
        prices.where(F.col("date") <= day(as_of))
        .withColumn("n", F.row_number().over(newest))
        .where("n <= 2")
        .groupBy(F.col("ticker").alias("asset"))
        .agg(
            F.max(F.when(F.col("n") == 1, F.col("price"))).alias("last_price"),
            F.max(F.when(F.col("n") == 2, F.col("price"))).alias("prev_price"),
        )
    )
    move = ratio(F.col("last_price"), F.when(F.col("prev_price") > 0, F.col("prev_price")))
    return (
        alloc.where("net_quantity > 0")
        .join(two, "asset", "left")
        .select(
            "account", "asset", "asset_type", "value_usd", "last_price",
            (F.col("value_usd") - ratio(F.col("value_usd"), move)).alias("day_gain_usd"),
        )
    )
