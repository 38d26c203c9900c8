"""As-of prices, currency conversion and point-in-time views of a ledger.

An as-of lookup never searches per row.  One date needs one ``max_by`` per ticker; many dates use the daily
calendar, where each quote is spread over the days it stays current, so the lookup is a plain equi-join on
(ticker, date) that Spark may broadcast or skew-split.  The calendar has tickers x days rows however large the
ledger grows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify as C

AsOf = "str | dt.date | DataFrame"


def day(value) -> Column:
    return F.lit(str(value)).cast("date")


def clip(ledger: DataFrame, as_of) -> DataFrame:
    """Rows up to ``as_of``: one date, or a table of (account, as_of)."""
    if isinstance(as_of, DataFrame):
        return ledger.join(as_of.select("account", "as_of"), "account").where("date <= as_of")
    return ledger.where(F.col("date") <= day(as_of)).withColumn("as_of", day(as_of))


def latest_prices(prices: DataFrame, as_of) -> DataFrame:
    """Last price of every ticker at one date."""
    return (
        prices.where(F.col("date") <= day(as_of))
        .groupBy("ticker")
        .agg(F.max_by("price", "date").alias("price"), F.max("date").alias("quoted_on"))
    )


def daily_prices(prices: DataFrame, until, max_age_days: int | None = None) -> DataFrame:
    """Price of every ticker on every calendar day from its first quote to ``until``.

    The window sees one ticker's quotes, at most one per calendar day.
    """
    by_day = Window.partitionBy("ticker").orderBy("date")
    last = F.coalesce(F.date_sub(F.lead("date").over(by_day), 1), day(until))
    if max_age_days is not None:
        last = F.least(last, F.date_add("date", max_age_days))
    return (
        prices.where(F.col("date") <= day(until))
        .select("ticker", "price", F.col("date").alias("quoted_on"), last.alias("last_day"))
        .select(
            "ticker",
            F.explode(F.sequence("quoted_on", "last_day")).alias("date"),
            "price",
            "quoted_on",
        )
    )


def usd_units(points: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Dollar value of one unit of every priced ticker.

    ``price`` stays in the listing currency; ``fx`` is the dollar rate of that currency (1 for dollar quotes,
    NULL when the rate is missing) and ``unit_usd`` their product.
    """
    quoted = points.select("ticker", *on, "price").withColumn("bucket", C.asset_type(F.col("ticker")))
    quoted = quoted.withColumn("pair", C.quote_currency_pair(F.col("bucket")))
    rates = points.where(F.col("ticker").endswith("USD=X")).select(
        F.col("ticker").alias("pair"), *on, F.col("price").alias("rate")
    )
    return quoted.join(rates, ["pair", *on], "left").select(
        "ticker",
        *on,
        "price",
        F.when(F.col("pair") == "USD", F.lit(1.0)).otherwise(F.col("rate")).alias("fx"),
        F.when(F.col("pair") == "USD", F.col("price"))
        .otherwise(F.col("price") * F.col("rate"))
        .alias("unit_usd"),
    )


def always_one(key: Column) -> Column:
    """Cash keys worth one dollar without a price row."""
    return (key == "USD") | C.is_stablecoin(key)


def add_rate(rows: DataFrame, key: str, daily: DataFrame, out: str = "rate") -> DataFrame:
    """Dollar rate of the cash key ``key`` on each row's ``date``; NULL where no quote exists yet.

    Cash keys and fee keys are dollars, stablecoins, currency pairs or ``COIN-USD``.
    """
    quotes = daily.select(F.col("ticker").alias(key), "date", F.col("price").alias("_quote"))
    return (
        rows.join(quotes, [key, "date"], "left")
        .withColumn(out, F.when(always_one(F.col(key)), F.lit(1.0)).otherwise(F.col("_quote")))
        .drop("_quote")
    )


def daily_rates(prices: DataFrame, until) -> DataFrame:
    """The daily calendar of what ``add_rate`` can ask for: currency pairs and coins."""
    return daily_prices(prices.where(F.col("ticker").endswith("USD=X") | F.col("ticker").endswith("-USD")), until)


def quotes_at(points: DataFrame, prices: DataFrame, until, max_age_days: int | None = None) -> DataFrame:
    """(ticker, date, price, quoted_on) for the different points (ticker, date) of ``points`` that a quote reaches.

    No calendar: points and quotes are sorted together inside (ticker, month), the last quote is carried along, and one row a
    month carries it over month borders.  Points are made different first, combined before the shuffle, so a ticker that
    half of the rows ask for costs at most a row a day.
    """
    asked = points.where((F.col("date") <= day(until)) & F.col("ticker").isNotNull()).select("ticker", "date").distinct()
    quote = F.struct("price", F.col("date").alias("quoted_on"))
    known = prices.where(F.col("date") <= day(until)).groupBy("ticker", "date").agg(F.max("price").alias("price"))
    events = asked.select("ticker", "date", F.lit(None).cast("struct<price: double, quoted_on: date>").alias("quote")).unionByName(
        known.select("ticker", "date", quote.alias("quote"))
    ).withColumn("month", F.trunc("date", "month"))
    inside = Window.partitionBy("ticker", "month").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    carried = events.withColumn("own", F.last("quote", ignorenulls=True).over(inside)).where("quote IS NULL")
    months = events.groupBy("ticker", "month").agg(F.max_by("quote", F.col("quote.quoted_on")).alias("last_quote"))
    before = Window.partitionBy("ticker").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    borders = months.select("ticker", "month", F.last("last_quote", ignorenulls=True).over(before).alias("old")).where("old IS NOT NULL")
    found = carried.join(borders, ["ticker", "month"], "left").withColumn("quote", F.coalesce("own", "old")).where("quote IS NOT NULL")
    if max_age_days is not None:
        found = found.where(F.datediff("date", "quote.quoted_on") <= max_age_days)
    return found.select("ticker", "date", "quote.price", "quote.quoted_on")


def price_asof(probes: DataFrame, prices: DataFrame, until, max_age_days: int | None = None) -> DataFrame:
    """Adds the latest price at or before each probe's date (optionally no older than ``max_age_days``)."""
    found = quotes_at(probes, prices, until, max_age_days).select("ticker", "date", "price")
    return probes.join(found, ["ticker", "date"], "left")


def market_value_usd(rows: DataFrame, prices: DataFrame, until) -> DataFrame:
    """Adds ``value_usd`` of (asset, quantity, date) rows; NULL where a price or rate is missing.

    Prices and the rates of their currencies are looked up together, at the days that occur in ``rows`` only.
    """
    typed = rows.withColumn("_type", C.asset_type(F.col("asset"))).withColumn("_pair", C.quote_currency_pair(F.col("_type")))
    keys = typed.select("date", F.explode(F.array("asset", "_pair")).alias("ticker"))
    found = quotes_at(keys.where("ticker <> 'USD'"), prices, until)
    quotes = found.select(F.col("ticker").alias("asset"), "date", F.col("price").alias("_price"))
    rates = found.where(F.col("ticker").endswith("USD=X")).select(F.col("ticker").alias("_pair"), "date", F.col("price").alias("_rate"))
    priced = typed.join(quotes, ["asset", "date"], "left").join(rates, ["_pair", "date"], "left")
    rate = F.when(F.col("_pair") == "USD", F.lit(1.0)).otherwise(F.col("_rate"))
    value = (
        F.when(F.col("_type").isin("cash_base", "cash_stable"), F.col("quantity"))
        .when(F.col("_type") == "cash_fx", F.col("quantity") * F.col("_price"))
        .otherwise(F.col("quantity") * (F.col("_price") * rate))
    )
    return priced.select(*rows.columns, value.alias("value_usd"))


def cash_to_usd(rows: DataFrame, prices: DataFrame, until) -> DataFrame:
    """Adds ``usd_value`` of cash amounts (asset, quantity, date); NULL where the rate is missing."""
    keyed = rows.withColumn("_type", C.asset_type(F.col("asset"))).withColumn(
        "_key", C.normalize_cash_asset(F.col("asset"), F.col("_type"))
    )
    return (
        add_rate(keyed, "_key", daily_rates(prices, until), "_rate")
        .withColumn("usd_value", F.col("quantity") * F.col("_rate"))
        .drop("_type", "_key", "_rate")
    )
