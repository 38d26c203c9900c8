"""Row validation and price-coverage checks.

Coverage works on distinct (asset, currency, day) combinations folded out of the ledger in one pass, never on one
scan per kind of ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions import classify as C
from ledgerloom.operators.asof import clip, day, latest_prices, usd_units
from ledgerloom.operators.groups import HOT_ROWS, running_total
from ledgerloom.operators.splits import positions


# --- ledger rows -----------------------------------------------------------------------------------------------

def validate_rows(rows: DataFrame) -> DataFrame:
    """Adds ``errors``: the codes of every rule a row breaks (empty when the row may be booked)."""
    asset, action = F.col("asset"), F.upper("action")
    bucket = C.asset_type(asset)
    blank = F.coalesce(F.trim(asset), F.lit("")) == ""
    no_price = F.col("price").isNull()
    cash_only = action.isin(*vocab.CASH_ONLY_ACTIONS)

    def bad(cond: Column, code: str) -> Column:
        return F.when(cond, F.lit(code))

    errors = F.array_compact(
        F.array(
            bad(F.coalesce(~action.isin(*vocab.USER_ACTIONS), F.lit(True)), "UNKNOWN_ACTION"),
            bad(blank, "ASSET_REQUIRED"),
            bad(action.isin("BUY", "SELL") & F.upper(asset).isin(*vocab.CURRENCIES), "BARE_CURRENCY_TRADE"),
            bad(~F.upper("currency").isin(*vocab.CURRENCIES), "UNKNOWN_CURRENCY"),
            bad(F.coalesce(F.trim("exchange"), F.lit("")) == "", "EXCHANGE_REQUIRED"),
            bad(F.coalesce(~(F.col("quantity") > 0), F.lit(True)), "QUANTITY_NOT_POSITIVE"),
            bad(F.col("price") <= 0, "PRICE_NOT_POSITIVE"),
            bad(F.col("fees") < 0, "FEES_NEGATIVE"),
            bad((action == "TRANSFER") & F.col("account").isNull(), "ACCOUNT_REQUIRED"),
            bad(action.isin("BUY", "SELL") & no_price, "PRICE_REQUIRED"),
            bad(cash_only & ~no_price, "PRICE_NOT_ALLOWED"),
            bad(cash_only & ~C.is_cash_like(asset, bucket), "CASH_ASSET_REQUIRED"),
            bad((action == "SPLIT") & C.is_cash_like(asset, bucket), "SPLIT_NEEDS_NON_CASH"),
        )
    )
    return rows.withColumn("errors", errors)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0).drop("errors")


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") > 0)


def oversold(ledger: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sales of more than was bought and not yet sold at that point of the (account, asset) ledger."""
    trades = ledger.where(F.col("action").isin("BUY", "SELL")).select(
        "account", "asset", "date", "id", "action", "quantity",
        F.when(F.col("action") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")).alias("signed"),
    )
    held = running_total(trades, ["account", "asset"], "signed", "held", hot_rows)
    return held.where((F.col("action") == "SELL") & (F.col("quantity") > F.col("held"))).select(
        "account", "asset", "date", "id", "quantity", "held"
    )


# --- prices of what is held ------------------------------------------------------------------------------------

def unpriced_holdings(ledger: DataFrame, prices: DataFrame, as_of) -> DataFrame:
    """Held assets without a price, or without the rate of their listing currency, at a date."""
    held = positions(clip(C.classified(ledger), as_of))
    units = usd_units(latest_prices(prices, as_of)).select(F.col("ticker").alias("asset"), "price", "fx")
    rows = held.join(units, "asset", "left")
    no_price = F.col("price").isNull()
    return rows.where(no_price | F.col("fx").isNull()).select(
        "account", "asset",
        F.when(no_price, F.col("asset")).otherwise(C.quote_currency_pair(F.col("asset_type"))).alias("missing"),
        F.when(no_price, F.lit("PRICE_UNAVAILABLE")).otherwise(F.lit("FX_PRICE_UNAVAILABLE")).alias("problem"),
        day(as_of).alias("as_of_date"),
    )


def guard_held_prices(ledger: DataFrame, prices: DataFrame, as_of) -> None:
    """Raises, naming the ticker, if any held asset cannot be priced."""
    first = unpriced_holdings(ledger, prices, as_of).orderBy("asset", "account").limit(1).collect()
    if first:
        row = first[0]
        raise ValueError(f"{row.problem}: {row.missing} as of {row.as_of_date}")


# --- required tickers and checkpoints --------------------------------------------------------------------------

def _entry(ticker: Column, second: Column, name: str) -> Column:
    return F.struct(ticker.alias("ticker"), second.alias(name))


def required_tickers(ledger: DataFrame) -> DataFrame:
    """Tickers the ledger needs prices or rates of, as (ticker, category)."""
    seen = ledger.select("asset", "currency", "fee_currency").distinct()
    seen = seen.withColumns(
        {"bucket": C.asset_type(F.col("asset")), "fee_bucket": C.asset_type(F.col("fee_currency"))}
    )
    asset, ccy, fee = F.col("asset"), F.col("currency"), F.col("fee_currency")
    bucket, fee_bucket = F.col("bucket"), F.col("fee_bucket")
    fiat = [c for c in vocab.CURRENCIES if c != "USD"]
    fx, own = F.lit("fx"), F.lit("asset")
    coin = ~fee_bucket.isin("cash_base", "cash_fx", "cash_stable") & (fee != "")
    entries = [
        (~(C.is_stablecoin(asset) | C.is_stable_bucket(asset)), asset, own),
        (ccy.isin(*fiat), F.concat(ccy, F.lit("USD=X")), fx),
        (C.is_foreign_stock(bucket), C.quote_currency_pair(bucket), fx),
        (bucket == "cash_fx", asset, fx),
        (asset.isin(*[f"CASH {c}" for c in vocab.CASH_BUCKET_CURRENCIES]),
         F.concat(F.substring(asset, 6, 3), F.lit("USD=X")), fx),
        (fee.isin(*vocab.BARE_FIAT), F.concat(fee, F.lit("USD=X")), fx),
        (fee.isNotNull() & coin, C.fee_ticker(fee, fee_bucket), own),
    ]
    listed = F.array_compact(F.array(*[F.when(c, _entry(t, k, "ticker_category")) for c, t, k in entries]))
    return seen.select(F.inline(listed)).where("ticker IS NOT NULL").distinct()


def bucket_activity(prices: DataFrame) -> DataFrame:
    """Days on which any ticker of a pricing bucket was quoted."""
    return prices.select(C.asset_type(F.col("ticker")).alias("bucket"), "date").distinct()


def last_bucket_dates(prices: DataFrame, end) -> DataFrame:
    """Last quoted day of each pricing bucket up to a date."""
    return (
        bucket_activity(prices).where(F.col("date") <= day(end)).groupBy("bucket").agg(F.max("date").alias("last_date"))
    )


def required_checkpoints(ledger: DataFrame, prices: DataFrame, end) -> DataFrame:
    """(ticker, checkpoint_date): trade days and the last market day, where the market was open at all."""
    traded = F.col("action").isin("BUY", "SELL")
    seen = ledger.select("asset", traded.alias("traded"), "date").distinct().withColumn(
        "asset_type", C.asset_type(F.col("asset"))
    )
    seen = seen.withColumn("cash_like", C.is_cash_like(F.col("asset"), F.col("asset_type")))
    asset, bucket, traded = F.col("asset"), F.col("asset_type"), F.col("traded")
    foreign = C.is_foreign_stock(bucket)
    money = (bucket == "cash_fx") | (asset.startswith("CASH ") & (asset != "CASH USD"))
    key = C.normalize_cash_asset(asset, bucket)
    listed = F.array_compact(
        F.array(
            F.when(traded & ~F.col("cash_like"), _entry(asset, F.col("date"), "date")),
            F.when(traded & foreign, _entry(C.quote_currency_pair(bucket), F.col("date"), "date")),
            F.when(money & (key != "USD") & ~C.is_stablecoin(key), _entry(key, F.col("date"), "date")),
        )
    )
    dates = seen.select(F.inline(listed)).distinct().withColumn("bucket", C.asset_type(F.col("ticker")))
    tickers = dates.select("ticker", "bucket").distinct()
    last = tickers.join(last_bucket_dates(prices, end), "bucket", "left").select(
        "ticker",
        F.when(F.col("bucket") == "crypto", day(end)).otherwise(F.col("last_date")).alias("date"),
        "bucket",
    )
    wanted = dates.unionByName(last).where("date IS NOT NULL")
    return (
        wanted.join(bucket_activity(prices), ["bucket", "date"], "left_semi")
        .select("ticker", F.col("date").alias("checkpoint_date"))
        .distinct()
    )


def missing_checkpoints(checkpoints: DataFrame, prices: DataFrame) -> DataFrame:
    quoted = prices.select("ticker", F.col("date").alias("checkpoint_date"))
    return checkpoints.join(quoted, ["ticker", "checkpoint_date"], "left_anti")


def coverage_issues(missing: DataFrame) -> DataFrame:
    """Missing days per ticker, as text."""
    days = F.array_sort(F.collect_set(F.col("checkpoint_date").cast("string")))
    return missing.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("missing_count"),
        F.concat(F.lit("missing_dates: "), F.array_join(days, ", ")).alias("issues"),
    )


def latest_quote_dates(required: DataFrame, prices: DataFrame) -> DataFrame:
    last = prices.groupBy("ticker").agg(F.max("date").alias("last_price_date"))
    return required.join(last, "ticker", "left")


def stale_tickers(required: DataFrame, prices: DataFrame, today, max_age_days: int = 2) -> DataFrame:
    """Required tickers whose last quote is older than ``max_age_days`` (one row per required entry)."""
    rows = latest_quote_dates(required, prices).where(
        F.col("last_price_date") < F.date_sub(day(today), max_age_days)
    )
    return rows.select("ticker", "last_price_date", F.datediff(day(today), "last_price_date").alias("age_days"))


def missing_or_stale(required: DataFrame, prices: DataFrame, today, max_age_days: int = 5) -> DataFrame:
    """Non-cash required tickers without a recent enough price, never-priced ones included."""
    ticker = F.col("ticker")
    need = required.select("ticker").distinct().where(~C.is_cash_like(ticker, C.asset_type(ticker)))
    fresh = prices.where(F.col("date").between(F.date_sub(day(today), max_age_days), day(today))).select("ticker")
    return need.join(fresh.distinct(), "ticker", "left_anti")


# --- reports ---------------------------------------------------------------------------------------------------

def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Several one-row results as one row: stacked with NULL gaps, then folded."""
    names = [n for p in parts for n in p.columns]
    stacked = None
    for part in parts:
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(n).alias(n) for n in names])


def _listed(rows: DataFrame, count: str, names: str, sep: str = ",") -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias(count), F.array_join(F.array_sort(F.collect_list("ticker")), sep).alias(names)
    )


def verify_prices(ledger: DataFrame, prices: DataFrame, today, max_age_days: int = 5) -> DataFrame:
    """Size, range, required tickers, coverage gaps and stale tickers of the price table in one row."""
    per_ticker = prices.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    stats = per_ticker.agg(
        F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("unique_tickers"),
        F.min("first").alias("start_date"), F.max("last").alias("end_date"),
    )
    required = required_tickers(ledger)
    gaps = missing_checkpoints(required_checkpoints(ledger, prices, today), prices).select("ticker").distinct()
    return _one_row(
        [
            stats,
            required.select("ticker").distinct().agg(F.count(F.lit(1)).alias("required_tickers")),
            gaps.agg(F.count(F.lit(1)).alias("coverage_issues")),
            stale_tickers(required, prices, today, max_age_days).agg(F.count(F.lit(1)).alias("stale_tickers")),
        ]
    )


def price_report(ledger: DataFrame, prices: DataFrame, today, max_age_days: int = 5) -> DataFrame:
    """What stands behind ``verify_prices``: one row per required ticker or ticker with a gap.

    ``missing_dates`` lists its checkpoints without a price, ``stale`` says that its last quote is too old.
    """
    days = F.array_sort(F.collect_set(F.col("checkpoint_date").cast("string")))
    gaps = missing_checkpoints(required_checkpoints(ledger, prices, today), prices).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("missing_count"), F.array_join(days, ",").alias("missing_dates")
    )
    need = required_tickers(ledger).select("ticker").distinct().withColumn("required", F.lit(True))
    old = F.col("last_price_date") < F.date_sub(day(today), max_age_days)
    return latest_quote_dates(need.join(gaps, "ticker", "full"), prices).select(
        "ticker", F.coalesce("required", F.lit(False)).alias("required"),
        F.coalesce("missing_count", F.lit(0)).alias("missing_count"), "missing_dates", "last_price_date",
        F.datediff(day(today), "last_price_date").alias("age_days"),
        (F.coalesce("required", F.lit(False)) & F.coalesce(old, F.lit(False))).alias("stale"),
    )


def freshness(ledger: DataFrame, prices: DataFrame, as_of, max_age_days: int = 2) -> DataFrame:
    """Last price day up to a date, its age, and whether anything is missing or stale."""
    gaps = missing_checkpoints(required_checkpoints(ledger, prices, as_of), prices).select("ticker")
    old = stale_tickers(required_tickers(ledger), prices, as_of, max_age_days).select("ticker")
    row = _one_row(
        [
            prices.where(F.col("date") <= day(as_of)).agg(F.max("date").alias("prices_as_of")),
            gaps.unionByName(old).agg((F.count(F.lit(1)) > 0).alias("stale")),
        ]
    )
    return row.select("prices_as_of", F.datediff(day(as_of), "prices_as_of").alias("price_age_days"), "stale")


def unhealthy_tickers(ledger: DataFrame, prices: DataFrame, today, max_age_days: int = 5) -> DataFrame:
    """Tickers with a coverage gap or a stale price."""
    gaps = missing_checkpoints(required_checkpoints(ledger, prices, today), prices).select(
        "ticker", F.lit(True).alias("gap"), F.lit(False).alias("old")
    )
    old = stale_tickers(required_tickers(ledger), prices, today, max_age_days).select(
        "ticker", F.lit(False).alias("gap"), F.lit(True).alias("old")
    )
    return gaps.unionByName(old).groupBy("ticker").agg(
        F.max("gap").alias("coverage_gap"), F.max("old").alias("stale_price")
    )


def data_quality_summary(ledger: DataFrame, prices: DataFrame, today, max_age_days: int = 5) -> DataFrame:
    """Counts and lists of stale tickers and coverage gaps."""
    old = stale_tickers(required_tickers(ledger), prices, today, max_age_days).select("ticker")
    gaps = missing_checkpoints(required_checkpoints(ledger, prices, today), prices).select("ticker").distinct()
    return _one_row([_listed(old, "stale_count", "stale_list"), _listed(gaps, "coverage_count", "coverage_list")])


def _wanted_tickers(ledger: DataFrame, tickers: list[str] | None) -> DataFrame:
    if not tickers:
        return required_tickers(ledger).select("ticker").distinct()
    return ledger.sparkSession.createDataFrame([(t,) for t in sorted(set(tickers))], "ticker string")


def repair_plan(ledger: DataFrame, prices: DataFrame, today, max_age_days: int, tickers: list[str] | None = None) -> DataFrame:
    """Per ticker (all required ones by default) whether it would be fetched or skipped as fresh.

    ``status`` is degraded where it has coverage gaps or a stale price.
    """
    need = _wanted_tickers(ledger, tickers)
    fresh = (
        prices.where(F.col("date") >= F.date_sub(day(today), max_age_days))
        .select("ticker").distinct().withColumn("fresh", F.lit(True))
    )
    gaps = (
        missing_checkpoints(required_checkpoints(ledger, prices, today), prices)
        .select("ticker").distinct().withColumn("gap", F.lit(True))
    )
    old = F.coalesce(F.col("last_price_date") < F.date_sub(day(today), max_age_days), F.lit(False))
    planned = need.join(fresh, "ticker", "left").join(gaps, "ticker", "left")
    return latest_quote_dates(planned, prices).select(
        "ticker",
        F.when(F.col("fresh"), F.lit("skip_fresh")).otherwise(F.lit("repair")).alias("plan"),
        F.when(F.coalesce("gap", F.lit(False)) | old, F.lit("degraded")).otherwise(F.lit("ok")).alias("status"),
    )


def repair_summary(
    ledger: DataFrame, prices: DataFrame, today, max_age_days: int, tickers: list[str] | None = None, start=None, end=None
) -> DataFrame:
    """One row about a repair run: its date range, how many tickers it would fetch or skip, and its status.

    The range runs from the first ledger row to ``today`` unless given.  A run over all required tickers is degraded
    while any has a gap or a stale price; a run over chosen ``tickers`` guarantees no coverage and is always ok.
    """
    plans = F.col("plan")
    counted = repair_plan(ledger, prices, today, max_age_days, tickers).agg(
        F.count(F.when(plans == "repair", 1)).alias("would_repair"),
        F.count(F.when(plans == "skip_fresh", 1)).alias("would_skip_fresh"),
    )
    first = day(start) if start is not None else F.coalesce(F.min("date"), day(today))
    parts = [ledger.agg(first.alias("range_start")), counted]
    if not tickers:
        bad = price_report(ledger, prices, today, max_age_days).agg(
            F.count(F.when(F.col("missing_count") > 0, 1)).alias("unresolved_missing"),
            F.count(F.when(F.col("stale"), 1)).alias("unresolved_stale"),
        )
        parts.append(bad)
    row = _one_row(parts).withColumn("range_end", day(end if end is not None else today))
    if tickers:
        row = row.withColumns({"unresolved_missing": F.lit(0).cast("long"), "unresolved_stale": F.lit(0).cast("long")})
    degraded = (F.col("unresolved_missing") > 0) | (F.col("unresolved_stale") > 0)
    return row.select(
        "range_start", "range_end", "would_repair", "would_skip_fresh", "unresolved_missing", "unresolved_stale",
        F.when(degraded, F.lit("degraded")).otherwise(F.lit("ok")).alias("status"),
    )


def metadata_cache(metadata: DataFrame, today, max_age_days: int = 5, asset: str | None = None) -> DataFrame:
    rows = metadata if asset is None else metadata.where(F.upper("ticker") == asset.upper())
    limit = F.date_sub(day(today), max_age_days).cast("timestamp")
    return rows.select(
        F.col("ticker").alias("asset"), "asset_kind", "sector", "industry", "region", "sector_weights", "source",
        F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at"),
        (F.col("fetched_at").isNull() | (F.col("fetched_at") < limit)).alias("is_stale"),
    )
