"""Cash legs of ledger rows and cash balances per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions import classify as C
from ledgerloom.operators.asof import always_one
from ledgerloom.operators.splits import split_steps, with_split_factor


def _separate_fee() -> Column:
    """Whether the fee of a trade is charged in another currency than the trade."""
    return (
        (F.coalesce("fee_currency", F.lit("")) != "")
        & (F.col("fee_currency") != F.coalesce("currency", F.lit("USD")))
        & (F.coalesce("fees", F.lit(0.0)) > 0)
    )


def ledger_legs(ledger: DataFrame) -> DataFrame:
    """What every row of a classified ledger moves, in one pass: cash and, for assets, the position.

    ``leg`` is "own" (``name`` is the asset) for the cash a row settles, "fee" (``name`` is the fee currency) for a fee
    charged in another currency, and "hold" for the quantity of a non-cash asset; a split is a "hold" leg that moves
    nothing and carries its ratio.  Names stay as the ledger has them: they are classified after the sums, on one row
    per name instead of one per ledger row (see ``keyed``).
    """
    rows = ledger.withColumn(
        "is_trade", F.col("action").isin("BUY", "SELL") & ~F.col("cash_like") & F.col("price").isNotNull()
    ).withColumn("fee_apart", F.col("is_trade") & _separate_fee())
    action, quantity = F.col("action"), F.col("quantity")
    amount = quantity * F.col("price")
    fees = F.coalesce("fees", F.lit(0.0))
    fee_inside = F.when(F.col("fee_apart"), F.lit(0.0)).otherwise(fees)
    delta = (
        F.when(F.col("is_trade") & (action == "BUY"), -(amount + fee_inside))
        .when(F.col("is_trade"), amount - fee_inside)
        .when(action.isin("BUY", "EXCHANGE_FROM", *vocab.CASH_IN), quantity)
        .when(action.isin("SELL", *vocab.CASH_OUT), -quantity)
        .otherwise(F.lit(0.0))
    )
    one = F.lit(1.0)

    def leg(kind, name, moved, split=one):
        return F.struct(
            F.lit(kind).alias("leg"), F.col(name).alias("name"), moved.alias("move"), split.alias("split")
        )

    is_split = action == "SPLIT"
    held = ~F.col("cash_like") & action.isin("BUY", "SELL", "EXCHANGE_TO", "EXCHANGE_FROM", "SPLIT")
    hold = leg("hold", "asset", C.position_delta(action, quantity), F.when(is_split, quantity).otherwise(one))
    own, fee = leg("own", "asset", delta), leg("fee", "fee_currency", -fees)
    # A fee of its own occurs on trades only, and every trade holds.
    legs = (
        F.when(F.col("fee_apart"), F.array(own, fee, hold)).when(held, F.array(own, hold)).otherwise(F.array(own))
    )
    keep = [c for c in ("account", "as_of") if c in ledger.columns]
    return rows.select(*keep, "date", "id", F.inline(legs))


def keyed(legs: DataFrame) -> DataFrame:
    """Adds the cash key, display currency and display bucket of the cash legs' (leg, name)."""
    name = F.col("name")
    own = F.col("leg") == "own"
    rows = legs.withColumn("_type", C.asset_type(name))
    rows = rows.withColumn("_own_key", C.cash_key(name, F.col("_type")))
    kind, own_key = F.col("_type"), F.col("_own_key")
    shown = C.cash_display_currency(own_key)
    cash_name = F.lit("CASH ")
    own_bucket = (
        F.when(name.startswith("CASH "), name)
        .when(kind == "cash_base", F.lit("CASH USD"))
        .when(kind == "cash_stable", F.concat(cash_name, F.upper(name)))
        .when(kind == "cash_fx", F.concat(cash_name, shown))
    )
    fee_bucket = (
        F.when(kind == "cash_base", F.lit("CASH USD"))
        .when(kind == "cash_fx", F.concat(cash_name, shown))
        .otherwise(F.concat(cash_name, name))
    )
    return rows.withColumns(
        {
            "cash_key": F.when(own, own_key).otherwise(C.fee_ticker(name, kind)),
            "currency": F.when(own, shown).when(kind == "cash_base", F.lit("USD")).otherwise(name),
            "display_bucket": F.when(own, own_bucket).otherwise(fee_bucket),
        }
    ).drop("_own_key")


def account_sums(clipped: DataFrame) -> DataFrame:
    """Positions and cash balances of every account in one scan of its ledger, zero ones dropped.

    ``kind`` is "asset" or "cash", ``instrument`` the asset or cash key.
    """
    legs = with_split_factor(ledger_legs(clipped), split_steps(clipped), "name", "t.leg = 'hold'")
    by_name = legs.groupBy("account", "as_of", "leg", "name").agg(
        F.sum(F.col("move") * F.try_divide("end_factor", "factor")).alias("quantity")
    )
    return (
        instruments(by_name)
        .groupBy("account", "as_of", "kind", "instrument")
        .agg(
            F.max("asset_type").alias("asset_type"),
            F.max("currency").alias("currency"),
            F.max("display_bucket").alias("display_bucket"),
            F.sum("quantity").alias("quantity"),
        )
        .where("quantity <> 0")
    )


def instruments(by_name: DataFrame) -> DataFrame:
    """Turns (leg, name) into (kind, instrument), with the pricing bucket of the instrument."""
    hold, key = F.col("leg") == "hold", F.col("cash_key")
    cash_bucket = (
        F.when(key == "USD", F.lit("cash_base"))
        .when(C.is_stablecoin(key), F.lit("cash_stable"))
        .otherwise(F.lit("cash_fx"))
    )
    return keyed(by_name).withColumns(
        {
            "kind": F.when(hold, F.lit("asset")).otherwise(F.lit("cash")),
            "instrument": F.when(hold, F.col("name")).otherwise(key),
            "asset_type": F.when(hold, F.col("_type")).otherwise(cash_bucket),
        }
    ).drop("leg", "name", "cash_key", "_type")


def cash(clipped: DataFrame, latest: DataFrame) -> DataFrame:
    """Cash per (account, cash key): balance and dollar value (a missing rate counts as 0).

    ``latest`` holds (ticker, price) at the ledger's as-of date.
    """
    balances = account_sums(clipped).where("kind = 'cash'")
    quotes = latest.select(F.col("ticker").alias("instrument"), F.col("price").alias("quote"))
    key = F.col("instrument")
    return balances.join(quotes, "instrument", "left").select(
        "account",
        "as_of",
        key.alias("cash_key"),
        "currency",
        F.coalesce("display_bucket", F.concat(F.lit("CASH "), F.col("currency"))).alias("display_bucket"),
        F.col("quantity").alias("balance"),
        F.when(always_one(key), F.col("quantity"))
        .otherwise(F.col("quantity") * F.coalesce("quote", F.lit(0.0)))
        .alias("usd_value"),
    )


def cash_balances(ledger: DataFrame) -> DataFrame:
    """Balances over the whole ledger without trade settlement: quantities only, per (key, currency, bucket)."""
    sums = ledger.groupBy("account", "asset", "asset_type").agg(
        F.sum(C.signed_holding(F.col("action"), F.col("quantity"), 1)).alias("moved")
    )
    rows = sums.withColumn("cash_key", C.cash_key(F.col("asset"), F.col("asset_type")))
    shown = C.cash_display_currency(F.col("cash_key"))
    label = (
        F.when(F.col("asset").startswith("CASH "), F.col("asset"))
        .when(F.col("asset_type") == "cash_base", F.lit("CASH USD"))
        .when(F.col("asset_type") == "cash_fx", F.concat(F.lit("CASH "), shown))
    )
    return (
        rows.groupBy("account", "cash_key", shown.alias("currency"), label.alias("display_bucket"))
        .agg(F.sum("moved").alias("balance"))
        .where("balance <> 0")
        .withColumn("display_bucket", F.coalesce("display_bucket", F.concat(F.lit("CASH "), F.col("currency"))))
    )
