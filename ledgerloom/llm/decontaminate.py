"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as their lower-cased words (runs of letters, digits and underscores) joined by single spaces.  A test
item of n characters may differ from a passage by ``budget = floor(RATE n)`` edits.  It is split into budget + 1 pieces; a
passage within the budget holds at least one piece unchanged.  One automaton finds all pieces in a text; around each hit,
Myers' bit-parallel distance (the item as the pattern, free start and end in the text) decides.

An item too short for an edit (budget 0) must occur unchanged, at word borders.

Test items reach the tasks in slices of about ``SLICE_CHARS`` characters.  The driver reads one slice, writes what its pass over
the documents gives, and only then reads the next, so neither the driver nor a task holds more than a slice (or one
longer item).  A benchmark of one slice needs no table in between.  Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import add_columns
from ledgerloom.sources.store import materialize

RATE = 0.05
SLICE_CHARS = 4_000_000
WORDS = re.compile(r"\w+")

Item = tuple[int, str]


def normal(text: str | None) -> str:
    return " ".join(WORDS.findall((text or "").lower()))


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of about the same length."""
    n = int(rate * len(item)) + 1
    edges = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def distance_at_most(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """Smallest edit distance of ``item`` to a substring of ``text``, with that substring's end; None above the budget."""
    m = len(item)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        # The text may start anywhere, so nothing enters from above.
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
            if score == 0:
                break
    return best


class Matcher:
    """All items of a slice, ready to search texts."""

    def __init__(self, items: tuple[Item, ...], rate: float = RATE):
        self.items = [(i, t, int(rate * len(t))) for i, t in items if t]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, rate) if budget else [(0, text)]:
                where[piece].append((k, offset))
        self.hits = None
        if where:
            self.hits = ahocorasick.Automaton()
            for piece, places in where.items():
                self.hits.add_word(piece, (len(piece), places))
            self.hits.make_automaton()

    def search(self, text: str) -> list[tuple[int, int]]:
        """(item id, smallest distance) of the items found in a normalised text."""
        if self.hits is None:
            return []
        windows: dict[int, list[int]] = defaultdict(list)
        for end, (size, places) in self.hits.iter(text):
            for k, offset in places:
                windows[k].append(end + 1 - size - offset)
        found = []
        for k, starts in windows.items():
            item_id, item, budget = self.items[k]
            best = None
            if not budget:
                ends = {len(text)} | {i for s in starts for i in (s + len(item),) if text[i : i + 1] == " "}
                if any((s == 0 or text[s - 1] == " ") and s + len(item) in ends for s in starts):
                    best = 0
            else:
                done = -len(item) - 1
                for s in sorted(set(starts)):
                    if s <= done:
                        continue
                    # Hits close together share one stretch of text.
                    done = s + budget
                    stretch = text[max(0, s - budget) : s + len(item) + 3 * budget]
                    got = distance_at_most(item, stretch, budget if best is None else best - 1)
                    if got:
                        best = got[0]
                        if best == 0:
                            break
            if best is not None:
                found.append((item_id, best))
        return found


@lru_cache(maxsize=2)
def _matcher(items: tuple[Item, ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def benchmark_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables of the different normalised texts (key, norm) and of all their ids (key, item_id).

    Items without words are left out; an item without an id has item_id -1.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1).cast("long")).alias("item_id"), "text")
    named = add_columns(items, [T.StructField("norm", T.StringType())], lambda b: [[normal(x.as_py()) for x in b.column("text")]], ["item_id"])
    named = materialize(named.where("norm <> ''").distinct(), "benchmark-items")
    texts = materialize(named.select("norm").distinct().withColumn("key", F.monotonically_increasing_id()), "benchmark-texts")
    return texts, materialize(named.join(texts, "norm").select("key", "item_id"), "benchmark-ids")


def item_slices(texts: DataFrame, slice_chars: int = SLICE_CHARS) -> Iterator[tuple[tuple[Item, ...], bool]]:
    """(items as (key, norm), whether this is the last slice); one slice is read at a time."""
    total = texts.agg(F.coalesce(F.sum(F.length("norm")), F.lit(0))).first()[0]
    n = -(-total // slice_chars)
    for k in range(n):
        rows = texts.where(F.pmod(F.xxhash64("norm"), F.lit(n)) == k).select("key", "norm").collect()
        yield tuple(sorted((r.key, r.norm) for r in rows)), k == n - 1


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, item_id, distance) of every item found in a document; clean documents have no row.

    Items with the same normalised text are all listed; an item without an id has item_id -1, one without words is never
    found.  A missing or empty text holds nothing; texts are searched whole, however long.  Of rows with the same doc_id,
    or none, each is searched; equal findings are listed once.  Other columns of both tables play no part, empty tables
    give no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("distance", T.LongType())])

    def one(items: tuple[Item, ...]) -> DataFrame:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, rate)
            for batch in batches:
                ids, texts = batch.column("doc_id"), batch.column("text")
                rows, found = [], []
                for i, value in enumerate(texts):
                    hits = matcher.search(normal(value.as_py()))
                    rows += [i] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array([x for x, _ in found], pa.int64()), pa.array([d for _, d in found], pa.int64())],
                    names=schema.names,
                )

        return docs.select("doc_id", "text").mapInArrow(step, schema)

    texts, ids = benchmark_items(benchmark)
    parts = [one(items) if last else materialize(one(items), "findings") for items, last in item_slices(texts, slice_chars)]
    if not parts:
        return docs.sparkSession.createDataFrame([], T.StructType([schema["doc_id"], T.StructField("item_id", T.LongType()), schema["distance"]]))
    found = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "key").agg(F.min("distance").alias("distance"))
    return found.join(ids, "key").groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no test item is found, with their own columns.

    Each slice goes over what the ones before it left, written as a table.  Missing and empty texts stay, rows with one id
    are judged one by one, and without benchmark items all rows stay; see ``contaminated`` for the rest.
    """
    for items, last in item_slices(benchmark_items(benchmark)[0], slice_chars):

        def step(batches: Iterator[pa.RecordBatch], items: tuple[Item, ...] = items) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, rate)
            for batch in batches:
                clean = [not matcher.search(normal(x.as_py())) for x in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(step, docs.schema)
        if not last:
            docs = materialize(docs, "clean-documents")
    return docs
