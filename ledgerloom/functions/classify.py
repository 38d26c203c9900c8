"""Ticker and cash classification as Column expressions.

The bucket (``asset_type``) drives pricing, the kind (``asset_kind``) drives display.  Functions that need the
bucket take it as a column, so a plan computes it once and later expressions only read it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocab


def pair(currency: str) -> str:
    return f"{currency}USD=X"


def _case(branches, default=None) -> Column:
    """CASE over (condition, value) branches in order."""
    (cond, value), *rest = branches
    column = F.when(cond, value)
    for cond, value in rest:
        column = column.when(cond, value)
    return column if default is None else column.otherwise(default)


def _lookup(key: Column, table: dict) -> Column:
    """Value of a small constant table, NULL where the key is absent."""
    return F.try_element_at(
        F.create_map(*[F.lit(x) for item in table.items() for x in item]), key
    )


def is_stablecoin(asset: Column) -> Column:
    return F.upper(asset).isin(*vocab.STABLECOINS)


def _bucket_symbol(asset: Column) -> Column:
    """Symbol inside a ``CASH XXX`` name."""
    return F.trim(F.substring(asset, 6, 64))


def is_stable_bucket(asset: Column) -> Column:
    return asset.startswith("CASH ") & is_stablecoin(_bucket_symbol(asset))


def asset_type(ticker: Column) -> Column:
    """Pricing bucket.  The order of the branches is part of the meaning."""
    listing = {suffix[1:]: f"stock_{ccy.lower()}" for suffix, ccy in vocab.LISTING_CURRENCY.items()}
    listed = F.when(ticker.contains("."), _lookup(F.substring_index(ticker, ".", -1), listing))
    branches = [
        (ticker == "USD", F.lit("cash_base")),
        (ticker.isin(*vocab.BARE_FIAT), F.lit("cash_fx")),
        (is_stablecoin(ticker), F.lit("cash_stable")),
        (ticker.endswith("USD=X"), F.lit("cash_fx")),
        (ticker.endswith("-USD"), F.lit("crypto")),
    ]
    return _case(branches, F.coalesce(listed, F.lit("stock_usd")))


def is_foreign_stock(bucket: Column) -> Column:
    return bucket.startswith("stock_") & (bucket != "stock_usd")


def is_cash_like(asset: Column, bucket: Column) -> Column:
    return bucket.isin("cash_base", "cash_fx", "cash_stable") | asset.startswith("CASH ")


def quote_currency_pair(bucket: Column) -> Column:
    """Cash key a pricing bucket settles in: the pair of a foreign listing, else USD."""
    return F.when(
        is_foreign_stock(bucket), F.concat(F.upper(F.substring(bucket, 7, 3)), F.lit("USD=X"))
    ).otherwise(F.lit("USD"))


def _named_bucket_pair(asset: Column) -> list:
    return [(asset == f"CASH {c}", F.lit(pair(c))) for c in vocab.CASH_BUCKET_CURRENCIES]


def normalize_cash_asset(asset: Column, bucket: Column) -> Column:
    """Price-table key of a cash amount; unknown names become ``NAME-USD``."""
    branches = [
        (bucket == "cash_stable", F.upper(asset)),
        (is_stable_bucket(asset), F.upper(_bucket_symbol(asset))),
        ((bucket == "cash_base") | (asset == "CASH USD"), F.lit("USD")),
        (asset.isin(*vocab.BARE_FIAT), F.concat(asset, F.lit("USD=X"))),
        (bucket == "cash_fx", asset),
        *_named_bucket_pair(asset),
        (asset.endswith("-USD") | asset.endswith("USD=X"), asset),
    ]
    return _case(branches, F.concat(asset, F.lit("-USD")))


def cash_key(asset: Column, bucket: Column) -> Column:
    """Cash bucket a ledger row settles in."""
    branches = [
        (bucket == "cash_stable", F.upper(asset)),
        (is_stable_bucket(asset), F.upper(_bucket_symbol(asset))),
        (
            bucket == "cash_fx",
            F.when(asset.isin(*vocab.BARE_FIAT), F.concat(asset, F.lit("USD=X"))).otherwise(asset),
        ),
        (is_foreign_stock(bucket), quote_currency_pair(bucket)),
        *_named_bucket_pair(asset),
    ]
    return _case(branches, F.lit("USD"))


def cash_display_currency(key: Column) -> Column:
    pairs = [pair(c) for c in vocab.CURRENCIES if c != "USD"]
    return F.when(key.isin(*pairs), F.substring(key, 1, 3)).otherwise(key)


def fee_ticker(currency: Column, bucket: Column) -> Column:
    """Price-table key of a fee: dollars by default, the pair of a fiat, ``COIN-USD`` otherwise.

    ``bucket`` is the pricing bucket of the fee currency.
    """
    return _case(
        [
            (currency.isNull() | (currency == "") | (bucket == "cash_base"), F.lit("USD")),
            (bucket == "cash_stable", F.upper(currency)),
            (
                bucket == "cash_fx",
                F.when(currency.isin(*vocab.BARE_FIAT), F.concat(currency, F.lit("USD=X"))).otherwise(currency),
            ),
        ],
        F.concat(currency, F.lit("-USD")),
    )


def currency_or_usd(currency: Column) -> Column:
    return F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD"))


def fee_currency_or_default(fee_currency: Column, currency: Column) -> Column:
    return F.coalesce(F.nullif(fee_currency, F.lit("")), F.nullif(currency, F.lit("")), F.lit("USD"))


def asset_kind(ticker: Column, quote_type: Column) -> Column:
    """Display kind: quoted type first, the shape of the ticker as fallback."""
    quoted = F.when(
        quote_type.isNotNull(), F.coalesce(_lookup(quote_type, vocab.QUOTE_KIND), F.lit("unknown"))
    )
    shape = _case(
        [
            (ticker == "USD", F.lit("cash")),
            (ticker.isin(*vocab.BARE_FIAT) | ticker.endswith("USD=X"), F.lit("fx")),
            (ticker.endswith("-USD"), F.lit("crypto")),
            (reduce(lambda a, b: a | b, [ticker.endswith(s) for s in vocab.LISTING_CURRENCY]), F.lit("stock")),
            (ticker.startswith("CASH ") | is_stablecoin(ticker), F.lit("cash")),
        ],
        F.lit("stock"),
    )
    return F.coalesce(quoted, shape)


def quote_kind(quote_type: Column) -> Column:
    return F.coalesce(_lookup(F.upper(quote_type), vocab.QUOTE_KIND), F.lit("unknown"))


def analysis_type(quote_type: Column) -> Column:
    return F.coalesce(
        _lookup(F.upper(quote_type), vocab.QUOTE_ANALYSIS_TYPE), F.lit("UNKNOWN")
    )


def annualisation_periods(kind: Column) -> Column:
    return F.when(kind == "CRYPTO", F.lit(vocab.CRYPTO_DAYS)).otherwise(F.lit(vocab.TRADING_DAYS))


def tracking_index(ticker: Column) -> Column:
    return F.coalesce(_lookup(F.upper(ticker), vocab.TRACKING_INDEX), F.lit(vocab.DEFAULT_INDEX))


def static_profile(ticker: Column) -> Column:
    """Sector and region that follow from the name alone; NULL for anything that must be looked up."""
    fiat = [c for c in vocab.CURRENCIES if c != "USD"]

    def profile(sector, region):
        return F.struct(F.lit(sector).alias("sector"), region.alias("region"))

    return _case(
        [
            (ticker == "USD", profile("Cash", F.lit("US"))),
            (is_stablecoin(ticker), profile("Crypto", F.lit("Global"))),
            (F.upper(ticker).isin(*fiat), profile("FX", F.upper(ticker))),
            (ticker.isin(*[pair(c) for c in vocab.CURRENCIES]), profile("FX", F.substring(ticker, 1, 3))),
            (ticker.startswith("CASH "), profile("Cash", F.lit("US"))),
            (ticker.endswith("-USD"), profile("Crypto", F.lit("Global"))),
        ]
    )


def fallback_sector(asset: Column, kind: Column) -> Column:
    """Sector used when the metadata names neither a sector nor sector weights."""
    name = F.upper(asset)
    fiat = [c for c in vocab.CURRENCIES if c != "USD"]
    by_shape = _case(
        [
            (name.isin(*vocab.FUND_SECTOR_WEIGHTS), F.lit(None).cast("string")),
            (name.isin(*vocab.FUND_SECTOR), _lookup(name, vocab.FUND_SECTOR)),
            ((name == "USD") | name.startswith("CASH "), F.lit("Cash")),
            (is_stablecoin(name) | name.endswith("-USD"), F.lit("Crypto")),
            (name.isin(*fiat) | name.isin(*[pair(c) for c in vocab.CURRENCIES]), F.lit("FX")),
            (kind == "fixed_income", F.lit("Bonds")),
        ]
    )
    return by_shape


def fallback_sector_weights(asset: Column) -> Column:
    def weights(table):
        return F.array(
            *[F.struct(F.lit(s).alias("sector"), F.lit(w).alias("weight")) for s, w in table.items()]
        )

    name = F.upper(asset)
    return _case([(name == t, weights(w)) for t, w in vocab.FUND_SECTOR_WEIGHTS.items()])


def is_fetchable(ticker: Column) -> Column:
    """Whether a quote source has to be asked for this ticker."""
    return ~(
        (ticker == "USD")
        | is_stablecoin(ticker)
        | F.upper(ticker).isin(*vocab.CURRENCIES)
        | ticker.rlike("^[A-Z]{3}USD=X$")
        | ticker.startswith("CASH ")
    )


def last_trading_day(day: Column) -> Column:
    """Saturday and Sunday fall back to Friday (Spark numbers Sunday 1)."""
    dow = F.dayofweek(day)
    return F.when(dow == 1, F.date_sub(day, 2)).when(dow == 7, F.date_sub(day, 1)).otherwise(day)


def parse_day(text: Column) -> Column:
    """``YYYY-MM-DD``, or the older ``DD-MM-YYYY``; NULL for any other text."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    old = F.when(text.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(text, "dd-MM-yyyy"))
    return F.coalesce(iso, old)


def signed_holding(action: Column, quantity: Column, exchange_from_sign: int) -> Column:
    """Ledger quantity with its sign in a holdings sum.

    Exchange-out rows already carry a negative quantity; some reports add it, others subtract it, so the
    caller names the sign.
    """
    return (
        F.when(action.isin("BUY", *vocab.CASH_IN), quantity)
        .when(action.isin("SELL", *vocab.CASH_OUT), -quantity)
        .when(action == "EXCHANGE_FROM", exchange_from_sign * quantity)
        .otherwise(F.lit(0.0))
    )


def position_delta(action: Column, quantity: Column) -> Column:
    """Quantity with its sign in a non-cash position."""
    return (
        F.when(action.isin("BUY", "EXCHANGE_TO"), quantity)
        .when(action.isin("SELL", "EXCHANGE_FROM"), -quantity)
        .otherwise(F.lit(0.0))
    )


def spread(bid: Column, ask: Column) -> Column:
    width = ask - bid
    return F.struct(
        width.alias("spread"),
        F.when(bid != 0, F.try_divide(width, bid) * 100).alias("spread_pct"),
    )


CLASSES = ("asset_type", "cash_like", "pay_key", "fee_key")


def classified(ledger: DataFrame) -> DataFrame:
    """Ledger with its pricing bucket, cash flag and the price-table keys of its currency and its fee.

    Columns the table already stores are kept, so an ingested ledger pays for the classification once.
    """
    if set(CLASSES) <= set(ledger.columns):
        return ledger
    rows = ledger.withColumns(
        {
            "asset_type": asset_type(F.col("asset")),
            "_paid": currency_or_usd(F.col("currency")),
            "_charged": fee_currency_or_default(F.col("fee_currency"), F.col("currency")),
        }
    )
    rows = rows.withColumns({"_paid_type": asset_type(F.col("_paid")), "_charged_type": asset_type(F.col("_charged"))})
    return rows.withColumns(
        {
            "cash_like": is_cash_like(F.col("asset"), F.col("asset_type")),
            "pay_key": normalize_cash_asset(F.col("_paid"), F.col("_paid_type")),
            "fee_key": fee_ticker(F.col("_charged"), F.col("_charged_type")),
        }
    ).drop("_paid", "_charged", "_paid_type", "_charged_type")


def sector_weights_of(text: Column) -> Column:
    """Array of (sector, weight) from JSON text; items that are not a text with a finite number are left out.

    NULL for text that is not a JSON array.
    """
    kind = lambda item, path: F.schema_of_variant(F.try_variant_get(item, path, "variant"))
    sound = F.filter(
        F.from_json(text, "array<variant>"),
        lambda x: (kind(x, "$.sector") == "STRING") & kind(x, "$.weight").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"),
    )
    return F.transform(
        sound,
        lambda x: F.struct(
            F.try_variant_get(x, "$.sector", "string").alias("sector"), F.try_variant_get(x, "$.weight", "double").alias("weight")
        ),
    )
