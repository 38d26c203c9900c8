"""Batches of ledger changes: exchanges, edits, deletions and splits, and what must be derived again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import classify as C

EDITABLE = ("date", "asset", "action", "quantity", "price", "currency", "fees", "fee_currency", "exchange")
LEDGER = ("account", "id", *EDITABLE, "exchange_group_id")


def check_exchanges(requests: DataFrame) -> DataFrame:
    """Adds ``errors`` to currency exchange requests (account, id, date, from_asset, to_asset, quantity, rate)."""
    rows = requests
    for side in ("from", "to"):
        asset = F.col(f"{side}_asset")
        rows = rows.withColumn(f"{side}_type", C.asset_type(asset))
        rows = rows.withColumn(f"{side}_key", C.normalize_cash_asset(asset, F.col(f"{side}_type")))
        rows = rows.withColumn(f"{side}_cash", C.is_cash_like(asset, F.col(f"{side}_type")))

    def bad(cond, code):
        return F.when(cond, F.lit(code))

    errors = F.array_compact(
        F.array(
            bad(F.coalesce(~(F.col("quantity") > 0), F.lit(True)), "QUANTITY_NOT_POSITIVE"),
            bad(F.coalesce(~(F.col("rate") > 0), F.lit(True)), "RATE_NOT_POSITIVE"),
            bad(F.col("from_key") == F.col("to_key"), "SAME_ASSET"),
            bad(~F.col("from_cash"), "FROM_NOT_CASH"),
            bad(~F.col("to_cash"), "TO_NOT_CASH"),
        )
    )
    return rows.withColumn("errors", errors).select(*requests.columns, "errors")


def exchange_legs(requests: DataFrame) -> DataFrame:
    """Both ledger rows of every valid exchange request, tied by a group id.  Ids are request id and the next one."""
    valid = check_exchanges(requests).where(F.size("errors") == 0)

    def leg(asset, action, quantity, offset):
        return F.struct(
            (F.col("id") + offset).alias("id"), F.col(asset).alias("asset"), F.lit(action).alias("action"),
            quantity.alias("quantity"),
        )

    legs = F.array(
        leg("from_asset", "EXCHANGE_FROM", -F.col("quantity"), 0),
        leg("to_asset", "EXCHANGE_TO", F.col("quantity") * F.col("rate"), 1),
    )
    none = F.lit(None)
    return valid.select(
        "account", "date", F.concat_ws("-", "account", F.col("id").cast("string")).alias("exchange_group_id"),
        F.inline(legs),
    ).select(
        "account", "id", "date", "asset", "action", "quantity", none.cast("double").alias("price"),
        F.lit("").alias("currency"), none.cast("double").alias("fees"), none.cast("string").alias("fee_currency"),
        F.lit("").alias("exchange"), "exchange_group_id",
    )


def split_rows(requests: DataFrame) -> DataFrame:
    """Ledger rows of split requests (account, id, date, asset, ratio); cash and ratios up to 0 are refused."""
    none = F.lit(None)
    asset = F.upper(F.trim("asset"))
    ok = requests.withColumn("asset", asset).where(F.col("ratio") > 0)
    ok = ok.where(~C.is_cash_like(F.col("asset"), C.asset_type(F.col("asset"))))
    return ok.select(
        "account", "id", "date", "asset", F.lit("SPLIT").alias("action"), F.col("ratio").alias("quantity"),
        none.cast("double").alias("price"), none.cast("string").alias("currency"),
        none.cast("double").alias("fees"), none.cast("string").alias("fee_currency"),
        F.lit("").alias("exchange"), none.cast("string").alias("exchange_group_id"),
    )


def resolved_deletes(ledger: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows to delete for the wanted (account, id) pairs, with their exchange siblings.

    ``refused`` marks an exchange leg without a group: deleting it alone would create or destroy value.
    """
    legs = F.col("action").isin("EXCHANGE_FROM", "EXCHANGE_TO")
    named = ledger.join(deletes.select("account", "id"), ["account", "id"], "left_semi")
    named = named.withColumn("refused", legs & F.col("exchange_group_id").isNull())
    groups = named.where(legs & ~F.col("refused")).select("account", "exchange_group_id").distinct()
    siblings = ledger.join(groups, ["account", "exchange_group_id"], "left_semi").withColumn("refused", F.lit(False))
    cols = ["account", "id", "date", "refused"]
    return named.select(*cols).unionByName(siblings.select(*cols)).distinct()


def apply_changes(
    ledger: DataFrame, edits: DataFrame, deletes: DataFrame, additions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The ledger after a batch, and the earliest affected day per account.

    ``edits`` has account, id and any editable columns (NULL keeps the old value).  Unknown ids change nothing.
    The batch is small beside the ledger: it meets it in joins on (account, id) only.
    """
    ledger = ledger.select(*LEDGER)
    fields = [c for c in EDITABLE if c in edits.columns]
    patch = edits.select("account", "id", F.lit(True).alias("_edited"), *[F.col(c).alias(f"_{c}") for c in fields])
    removed = resolved_deletes(ledger, deletes).where(~F.col("refused"))
    kept = ledger.join(removed.select("account", "id"), ["account", "id"], "left_anti")
    merged = kept.join(patch, ["account", "id"], "left")
    after = merged.select(
        "account", "id",
        *[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in EDITABLE],
        "exchange_group_id",
    ).withColumn("action", F.upper("action"))
    touched = merged.where("_edited").select(
        "account", (F.least("date", "_date") if "date" in fields else F.col("date")).alias("date")
    )
    touched = touched.unionByName(removed.select("account", "date")).unionByName(additions.select("account", "date"))
    recalc = touched.groupBy("account").agg(F.min("date").alias("recalc_from"))
    return after.unionByName(additions.select(*LEDGER)), recalc
