"""Named queries of the corpus operators, and those that SQL can express as SQL."""

from __future__ import annotations

from ledgerloom.llm import decontaminate, html, licenses, merkle, mixing, negatives, pieces, quality, secrets, simhash, suffixes, urls, windows
from ledgerloom.llm.common import table
from ledgerloom.llm.oracle import SQL



def vocabulary_path() -> str:
    """The merge-type model among the public tokenizer files of this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES = {
    "op1_suffix_dedup": lambda spark, d: suffixes.string_digest(table(spark, d, "documents")),
    "op2_simhash": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op3_quality_rules": lambda spark, d: quality.quality_report(table(spark, d, "documents")),
    "op4_decontaminate": lambda spark, d: decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op5_license_scan": lambda spark, d: licenses.scan_licenses(table(spark, d, "documents")),
    "op6_secret_scan": lambda spark, d: secrets.scan_secrets(table(spark, d, "documents")),
    "op7_source_mix": lambda spark, d: mixing.mix_report(table(spark, d, "documents")),
    "op8_url_filter": lambda spark, d: urls.judge_urls(table(spark, d, "pages"), urls.rule_table(spark)),
    "op9_html_text": lambda spark, d: html.extract_text(table(spark, d, "pages")),
    "op10_window_dedup": lambda spark, d: windows.window_digest(table(spark, d, "documents")),
    "op11_hard_negatives": lambda spark, d: negatives.hard_negatives(table(spark, d, "embeddings")),
    "op12_sentencepiece": lambda spark, d: pieces.piece_digest(table(spark, d, "documents"), vocabulary_path()),
    "op13_merkle_manifest": lambda spark, d: merkle.folded(table(spark, d, "documents")),
}

__all__ = ["QUERIES", "SQL"]
