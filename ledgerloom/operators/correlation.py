"""Correlation of held assets.

A pair's correlation depends on prices alone, so it is computed once per pair of tickers that some account holds
together and then joined to the accounts.  Returns meet through equi-joins on (ticker, date) of those pairs; no
date group is paired with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify as C
from ledgerloom.operators.asof import day
from ledgerloom.sources.store import materialize


def price_returns(quotes: DataFrame) -> DataFrame:
    """Return of each quote since the ticker's quote before."""
    order = Window.partitionBy("ticker").orderBy("date")
    before = F.lag("price").over(order)
    return quotes.select("ticker", "date", "price", before.alias("before")).select(
        "ticker", "date", F.when(F.col("before") != 0, F.try_divide("price", "before") - 1.0).alias("ret"), "before"
    )


def pair_moments(pairs: DataFrame, returns: DataFrame) -> DataFrame:
    """Sums over common dates of every (asset_a, asset_b) pair."""
    a = returns.select(F.col("ticker").alias("asset_a"), "date", F.col("ret").alias("x"))
    b = returns.select(F.col("ticker").alias("asset_b"), "date", F.col("ret").alias("y"))
    x, y = F.col("x"), F.col("y")
    both = pairs.join(a, "asset_a").join(b, ["asset_b", "date"]).where(x.isNotNull() & y.isNotNull())
    return both.groupBy("asset_a", "asset_b").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
    )


def _pearson(least: int):
    vx = F.greatest(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    vy = F.greatest(F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"), F.lit(0.0))
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    return F.when(
        (F.col("n") >= least) & (vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(F.greatest(vx * vy, F.lit(1e-12))))
    )


def held_pairs(held: DataFrame, half: bool) -> DataFrame:
    """Pairs of assets an account holds together: the rows of the report itself."""
    a = held.select("account", F.col("asset").alias("asset_a"), *[F.col(c).alias(f"{c}_a") for c in held.columns[2:]])
    b = held.select("account", F.col("asset").alias("asset_b"), *[F.col(c).alias(f"{c}_b") for c in held.columns[2:]])
    pairs = a.join(b, "account")
    return pairs.where("asset_a < asset_b") if half else pairs


def correlation_matrix(ledger: DataFrame, prices: DataFrame, as_of, window_months: int = 12) -> DataFrame:
    """Correlation of every ordered pair of long positions per account, itself included; NULL below 5 common days."""
    rows = C.classified(ledger.where(F.col("date") <= day(as_of)))
    held = (
        rows.where(~F.col("cash_like"))
        .groupBy("account", "asset")
        .agg(F.sum(C.signed_holding(F.col("action"), F.col("quantity"), -1)).alias("net"))
        .where("net > 0")
        .select("account", "asset")
    )
    # Small beside the ledger and used several times: written once, so the ledger is scanned once.
    held = materialize(held, "held")
    quotes = prices.where(
        (F.col("date") > F.add_months(day(as_of), -window_months)) & (F.col("date") <= day(as_of)) & (F.col("price") > 0)
    ).join(held.select(F.col("asset").alias("ticker")).distinct(), "ticker", "left_semi")
    order = Window.partitionBy("ticker").orderBy("date")
    before = F.lag("price").over(order)
    returns = quotes.withColumn("before", before).where("before > 0").select(
        "ticker", "date", ((F.col("price") - F.col("before")) / F.col("before")).alias("ret")
    )
    pairs = held_pairs(held, half=False)
    # The sums of (a, b) serve (b, a) as well.
    moments = pair_moments(pairs.select("asset_a", "asset_b").where("asset_a <= asset_b").distinct(), returns)
    rho = moments.select("asset_a", "asset_b", _pearson(5).alias("correlation"))
    low, high = F.least("asset_a", "asset_b"), F.greatest("asset_a", "asset_b")
    keyed = pairs.select("account", "asset_a", "asset_b", low.alias("lo"), high.alias("hi"))
    return keyed.join(
        rho.select(F.col("asset_a").alias("lo"), F.col("asset_b").alias("hi"), "correlation"), ["lo", "hi"]
    ).select("account", "asset_a", "asset_b", "correlation")


def diversification(
    alloc: DataFrame, prices: DataFrame, as_of, lookback_days: int = 252, min_correlation: float = 0.0
) -> DataFrame:
    """Concentration, effective holdings and pairwise correlation of each account's positive weights."""
    weights = alloc.where("allocation_pct > 0").select(
        "account", "asset", (F.col("allocation_pct") / 100.0).alias("wgt")
    )
    weights = materialize(weights, "weights")
    quotes = prices.where(F.col("date").between(F.date_sub(day(as_of), lookback_days), day(as_of)))
    enough = quotes.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    risky = weights.where(~C.is_cash_like(F.col("asset"), C.asset_type(F.col("asset"))))
    priced = risky.join(
        enough.select(F.col("ticker").alias("asset")), "asset", "left_semi"
    ).select("account", "asset", "wgt")
    returns = price_returns(quotes).where("ret IS NOT NULL")
    pairs = held_pairs(priced, half=True)
    moments = pair_moments(pairs.select("asset_a", "asset_b").distinct(), returns)
    rho = moments.select("asset_a", "asset_b", _pearson(2).alias("rho")).where("rho IS NOT NULL")
    strong = F.abs("rho") >= min_correlation
    per_account = pairs.join(rho, ["asset_a", "asset_b"]).groupBy("account").agg(
        F.avg(F.when(strong, F.col("rho"))).alias("avg_pairwise_correlation"),
        F.max(F.when(strong, F.col("rho"))).alias("max_pairwise_correlation"),
        F.min(F.when(strong, F.col("rho"))).alias("min_pairwise_correlation"),
        F.sum(F.col("wgt_a") * F.col("wgt_b") * F.col("rho")).alias("adjust"),
    )
    base = weights.groupBy("account").agg(
        F.sum(F.col("wgt") * F.col("wgt")).alias("hhi_frac"), F.count(F.lit(1)).alias("total_holdings")
    )
    return base.join(per_account, "account", "left").select(
        "account", day(as_of).alias("as_of_date"),
        (F.col("hhi_frac") * 10000.0).alias("hhi"), "total_holdings",
        F.coalesce(F.try_divide(F.lit(1.0), "hhi_frac"), F.lit(0.0)).alias("effective_holdings"),
        "avg_pairwise_correlation", "max_pairwise_correlation", "min_pairwise_correlation",
        ((F.col("hhi_frac") + 2.0 * F.coalesce("adjust", F.lit(0.0))) * 10000.0).alias("correlation_weighted_hhi"),
    )
