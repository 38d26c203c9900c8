"""Explicit schemas of the ledger model (nothing is inferred)."""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("account", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("asset", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("fees", T.DoubleType()),
        T.StructField("fee_currency", T.StringType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("exchange_group_id", T.StringType()),
    ]
)

PRICES = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("price", T.DoubleType()),
    ]
)

SECTOR_WEIGHTS = T.ArrayType(
    T.StructType([T.StructField("sector", T.StringType()), T.StructField("weight", T.DoubleType())])
)

METADATA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("quote_type", T.StringType()),
        T.StructField("long_name", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("asset_kind", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("sector_weights", SECTOR_WEIGHTS),
        T.StructField("source", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
