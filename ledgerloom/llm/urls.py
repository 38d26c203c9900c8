"""URL filter: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Every (host, path) is expanded once into all suffixes of its host at label borders, times all prefixes of its path at
slashes (the empty one and the whole path included).  Expressions meet rules in an equi-join on the first 32 bits of
their SHA-256; equal full digests confirm a hit.  The longest rule that fits decides.

Rule paths are empty, end in ``/``, or name one whole path.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, UPPER

# Fixed values of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
PREFIX_DIGITS = 8


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule, verdict, digest, prefix); of rules for the same host and path the blocking one holds."""
    rows = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in rules)
    return prepare_rules(spark.sql(f"SELECT * FROM VALUES {rows} AS t(verdict, host, path)"))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """From (verdict, host, path); rows without a host or verdict are left out, a missing path is empty."""
    path = F.coalesce("path", F.lit(""))
    rule = F.concat(F.translate("host", UPPER, LOWER), path)
    keyed = rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull()).select(rule.alias("rule"), "verdict")
    return keyed.groupBy("rule").agg(F.max("verdict").alias("verdict")).select(
        "rule", "verdict", F.sha2("rule", 256).alias("digest"),
        F.substring(F.sha2("rule", 256), 1, PREFIX_DIGITS).alias("prefix"),
    )


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def expressions(places: DataFrame) -> DataFrame:
    """(host, path, expression) for every host suffix and path prefix."""
    suffixes = """transform(sequence(1, size(split(host, '[.]'))),
      i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))"""
    prefixes = """array_distinct(concat(array('', path), transform(sequence(1, size(split(path, '/')) - 1, 1),
      i -> concat(array_join(slice(split(path, '/'), 1, i), '/'), '/'))))"""
    slashed = F.when(F.contains("path", F.lit("/")), F.expr(prefixes)).otherwise(F.array_distinct(F.array(F.lit(""), "path")))
    one_side = places.where("host <> ''").select("host", "path", F.explode(F.expr(suffixes)).alias("_suffix"))
    return one_side.select("host", "path", "_suffix", F.explode(slashed).alias("_prefix")).select(
        "host", "path", F.concat("_suffix", "_prefix").alias("expression")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    A missing url, or one without ``://``, has an empty host and path, fits no rule and gets ``default``.  Repeated
    rows stay repeated.  Each distinct (host, path) is judged once, so a popular place costs one look-up.
    """
    host, path = host_and_path(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    digest = F.sha2("expression", 256)
    candidates = (
        expressions(placed.select("host", "path").distinct())
        .select("host", "path", digest.alias("_digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("_prefix"))
        .join(rules, F.col("_prefix") == F.col("prefix"))
        .where(F.col("_digest") == F.col("digest"))
    )
    judged = candidates.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("best")
    )
    return placed.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
