"""Writes: price and metadata upserts, dated copies of tables, document output, removal of bad rows.

Prices, copies and documents are tables in versions (see ``versions``): readers never see half a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.schemas import PRICES
from ledgerloom.sources.versions import Conflict, Version, VersionedTable


def merge_prices(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Prices after an upsert: the incoming row with the highest ``seq`` wins its (ticker, date).

    A grouped maximum instead of a ranking window: copies of one hot (ticker, date) combine before the shuffle.
    """
    old = current.select("ticker", "date", "price", F.lit(-1).cast("long").alias("seq"))
    new = incoming.select("ticker", "date", "price", F.col("seq").cast("long").alias("seq"))
    return old.unionByName(new).groupBy("ticker", "date").agg(F.max_by("price", "seq").alias("price"))




def month() -> Column:
    return F.date_format("date", "yyyy-MM")


def price_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, PRICES)


def upsert_prices(path: str, incoming: DataFrame, batch: tuple[str, int] | None = None) -> Version:
    """Upserts (ticker, date, price, seq) into a price table in months; only months that occur in ``incoming`` are rewritten."""
    return price_table(incoming.sparkSession, path).update(incoming, month(), merge_prices, batch)


def write_prices(path: str, prices: DataFrame) -> Version:
    """Makes ``prices`` the contents of the months that occur in it."""
    return price_table(prices.sparkSession, path).update(prices, month(), lambda _, new: new)


def read_price_table(spark: SparkSession, path: str) -> DataFrame:
    return price_table(spark, path).read()


QUOTE_COLUMNS = ("quote_type", "long_name", "currency", "fetched_at")
PROFILE_COLUMNS = ("asset_kind", "sector", "industry", "region", "sector_weights", "source", "fetched_at")


def merge_metadata(current: DataFrame, incoming: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Metadata after an upsert of one set of columns: incoming values replace, NULLs too; other columns stay."""
    new = incoming.select("ticker", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    merged = current.join(new, "ticker", "full")
    return merged.select(
        "ticker",
        *[
            F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in current.columns
            if c != "ticker"
        ],
    )


def purge_bad_prices(prices: DataFrame) -> DataFrame:
    """Drops rows that price the dollar at anything but 1."""
    return prices.where(~((F.col("ticker") == "USD") & (F.col("price") != 1.0)))


def dated_copy(table: DataFrame, folder: str, name: str, stamp: str) -> int:
    """Copies a table under its date and returns the rows copied; a copy of that date that is there stays, and 0 is returned.

    The copy is a version of its own, so one that fails half-way does not count as being there.
    """
    copies = VersionedTable(table.sparkSession, f"{folder.rstrip('/')}/{name}/{stamp}", table.schema)
    since = copies.current()
    if since.number:
        return 0
    try:
        made = copies.write(table, F.lit("all"), ["all"], since)
    except Conflict:
        return 0
    return copies.read(made).count()


def dated_copies(tables: dict[str, DataFrame], folder: str, stamp: str) -> dict[str, int]:
    """A dated copy of each table: rows copied by name."""
    return {name: dated_copy(table, folder, name, stamp) for name, table in tables.items()}


def read_dated_copy(table: DataFrame, folder: str, name: str, stamp: str) -> DataFrame:
    """The copy of that date of a table with the schema of ``table``."""
    return VersionedTable(table.sparkSession, f"{folder.rstrip('/')}/{name}/{stamp}", table.schema).read()


DOCUMENTS = StructType([StructField("account", StringType()), StructField("document", StringType())])


def document_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, DOCUMENTS)


def write_documents(documents: DataFrame, path: str, buckets: int = 16) -> Version:
    """Upserts one JSON document an account; readers see all documents of before or all of after.

    Documents of accounts that are not in ``documents`` stay.
    """
    part = F.lpad(F.pmod(F.xxhash64("account"), F.lit(buckets)).cast("string"), 6, "0")

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("account"), "account", "left_anti").select("account", "document").unionByName(new)

    return document_table(documents.sparkSession, path).update(documents.select("account", "document"), part, merge)
