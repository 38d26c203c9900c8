"""Quality rules with thresholds that adapt to each language and source.

Every document gets counts (words, symbols, repeated lines, ...) and five shares made of them.  Shares are summed up in
mergeable quantile sketches: a share becomes a whole number of ten-thousandths, of which the six leading binary digits
are kept (relative error below 1/32, integer arithmetic only, so merging in any order gives the same sketch).

The thresholds of a (language, source) group come from its own sketch: a share may lie beyond the group's tail quantile by as many
times the way from its median to that quantile as ``SHARES`` says, plus a floor that only keeps single marks from counting where
the sketch is all zero.  Shares that sound texts keep close to the middle of their group (symbols, capitals, word length) take
the 90th percentile and three times its way; those that a few sound texts exceed by far (repeated lines and passages) the
99th and once its way.  Word length has a lower fence too, mirrored.  Groups of fewer than ``MIN_DOCS`` documents take the
merged sketch of their language, or of everything.  Documents then meet their thresholds in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import add_columns, long_field
from ledgerloom.sources.store import materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SPACES = " \t\n\x0b\x0c\r"
UNIT = 10_000

#: Share: numerator, denominator, tail percentile, reach beyond it in ways from the median, floor in ten-thousandths.
SHARES = {
    "symbol": ("n_symbols", "n_words", 90, 3, 100),
    "upper": ("n_upper", "word_chars", 90, 3, 50),
    "dup_line": ("n_dup_lines", "n_lines", 99, 1, 100),
    "repeat": ("n_repeat_words", "n_words", 99, 1, 100),
    "length": ("word_chars", "n_words", 90, 3, 500),
}
MIN_DOCS, MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50, 50


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    windows, copies = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)[1:]
    twice = copies[windows] >= 2
    marked = np.zeros(n, bool)
    for shift in range(3):
        marked[shift : n - 2 + shift] |= twice
    return int(marked.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The figures of ``COUNTS``; all 0 for a missing text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    in_words = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - (len(raw) - in_words),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(raw) - len(raw.translate(None, CAPITALS)),
        len(lines),
    )


def _counts(batch: pa.RecordBatch) -> list[list[int]]:
    texts = batch.column("text")
    return list(map(list, zip(*(text_counts(x.as_py()) for x in texts), strict=True))) or [[] for _ in COUNTS]


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    return add_columns(docs, [long_field(c) for c in COUNTS], _counts, keep)


def share(name: str) -> Column:
    """Ten-thousandths, as a whole number; 0 where nothing is counted."""
    top, bottom, *_ = SHARES[name]
    return F.expr(f"CASE WHEN {bottom} = 0 THEN 0L ELSE ({top} * {UNIT}L) div {bottom} END")


def bucket(value: Column) -> Column:
    """Six leading binary digits of a whole number, the others 0."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def sketches(scored: DataFrame) -> DataFrame:
    """(lang, source, share, bucket, n) over the documents that pass the base rules: one small histogram a group."""
    parts = F.array(*[F.struct(F.lit(s).alias("share"), bucket(share(s)).alias("bucket")) for s in SHARES])
    passed = scored.where(~base_failed()).select("lang", "source", F.inline(parts))
    return passed.groupBy("lang", "source", "share", "bucket").agg(F.count(F.lit(1)).alias("n"))


LEVELS = ("below", "middle", "above")


def _per_share(place: int) -> Column:
    return F.create_map(*[x for s, rule in SHARES.items() for x in (F.lit(s), F.lit(rule[place]).cast("long"))])[F.col("share")]


def _levels(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Median, tail quantiles on both sides and number of documents of each group's sketch (some hundred buckets at most)."""
    merged = sketch.groupBy(*keys, "share", "bucket").agg(F.sum("n").alias("n"))
    listed = merged.groupBy(*keys, "share").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("h"), F.sum("n").alias("docs")
    ).withColumn("tail", _per_share(2))
    rank = "aggregate(h, named_struct('c', 0L, 'v', -1L), (a, x) -> named_struct('c', a.c + x.n, 'v', "
    rank += "CASE WHEN a.v >= 0 THEN a.v WHEN 100 * (a.c + x.n) >= {p} * docs THEN x.bucket ELSE -1L END), a -> a.v)"
    percents = ("(100 - tail)", "50", "tail")
    return listed.select(*keys, "share", F.struct("docs", *[F.expr(rank.format(p=p)).alias(n) for n, p in zip(LEVELS, percents, strict=True)]).alias("q"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): ``low`` and ``high`` of each share, as columns ``<share>_low`` and ``<share>_high``."""
    own = _levels(sketch, ["lang", "source"])
    language = _levels(sketch, ["lang"]).select(F.col("lang").alias("_lang"), F.col("share").alias("_share"), F.col("q").alias("by_lang"))
    whole = _levels(sketch, []).select(F.col("share").alias("_any"), F.col("q").alias("by_all"))
    found = (
        own.join(language, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("share") == F.col("_share")))
        .join(whole, F.col("share") == F.col("_any"))
        .withColumn(
            "q", F.when(F.col("q.docs") >= MIN_DOCS, F.col("q")).when(F.col("by_lang.docs") >= MIN_DOCS, F.col("by_lang")).otherwise(F.col("by_all"))
        )
    )
    reach, floor = _per_share(3), _per_share(4)
    sided = found.select(
        "lang", "source", "share",
        (F.col("q.above") + reach * (F.col("q.above") - F.col("q.middle")) + floor).alias("high"),
        (F.col("q.below") - reach * (F.col("q.middle") - F.col("q.below")) - floor).alias("low"),
    )
    return sided.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("share") == s, F.col(side))).alias(f"{s}_{side}") for s in SHARES for side in ("low", "high")]
    )


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    Needs doc text, lang and source (null languages and sources form groups of their own).  A missing or empty text
    has no words, so it fails the base rules.  Where no document passes the base rules there is no threshold, and
    nothing that could fail it.  Texts of any length count whole; rows with one id, or none, are judged one by one, and equal
    rows alike.  An empty table gives no rows.  Texts are counted once, into a written table.
    """
    scored = materialize(counted(docs, list(dict.fromkeys([*keep, "lang", "source"]))), "counted")
    limits = thresholds(sketches(scored))
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    inside = F.lit(True)
    for s in SHARES:
        inside = inside & (share(s) <= F.coalesce(f"{s}_high", share(s)))
    inside = inside & (share("length") >= F.coalesce("length_low", share("length")))
    return scored.join(
        limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    ).select(*keep, *COUNTS, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ..., base_failed, kept)."""
    return judged(docs, ["doc_id"])


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    own = {c: f"_own_{c}" for c in docs.columns if c in (*COUNTS, "base_failed", "kept")}
    back = {v: k for k, v in own.items()}
    renamed = docs.withColumnsRenamed(own)
    return judged(renamed, renamed.columns).where("kept").select(*renamed.columns).withColumnsRenamed(back)
