"""The corpus pipeline: documents in, a weighted mix of clean documents out.

Each stage reads what its predecessor wrote.  All but the last return the columns of ``documents``, and of any other columns
the table has; those may be called like columns the stages make on the way.

Odd rows: a missing or empty text has no words and goes in the first stage, as do texts under its word count; texts are never
cut, however long.  Rows without an id stay apart from each other in the second stage and are else treated like others;
of rows that repeat an id each is judged by its own text.  Missing languages and sources are groups of their own.
Equal rows are near-duplicates where they have ids; what repeats after that is mixed row by row.  An empty table gives an
empty table after every stage, an empty benchmark leaves all documents.  Ties among duplicates go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, mixing, quality, secrets, simhash
from ledgerloom.llm.common import table
from ledgerloom.sources.store import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source; none of them without words."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; rows without id all stay."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows of one id are judged one by one."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; a missing text stays missing."""
    return secrets.mask_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the number of copies and the words they give; every row is rounded on its own."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_masking),
    ("source mix", source_mix),
]

# Fingerprints, edit distances and random rounding have no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
