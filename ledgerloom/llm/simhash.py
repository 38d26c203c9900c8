"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints have 64 bits; two link at ``BITS`` or fewer differing ones.  Cut into more than ``BITS`` parts, two linked
fingerprints agree in some parts entirely (pigeonhole), so each fingerprint goes to one bucket for every choice of
agreeing parts; the number of parts grows with the number of fingerprints, which keeps buckets small.  A bucket above
``TILE`` fingerprints is cut into tiles, and every pair of tiles meets in a cell of its own.

Inside a bucket fingerprints are sorted by Gray rank, which puts similar ones side by side, and grouped into a tree.  A
node keeps the bits all its fingerprints share and its parent does not: a search adds up the differences in those bits
from the root down and drops a whole group as soon as they exceed ``BITS``.

A bucket reports one link a fingerprint at most, to the smallest fingerprint it is connected with there.  Components of
these links are found by large-star and small-star rounds on stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import add_columns, long_field
from ledgerloom.sources.store import materialize

# Fixed values of the contract.
SHINGLE, SEED, BITS = 4, 42, 4
#: Up to so many distinct fingerprints: cut into so many parts.
PARTS = ((1 << 19, 5), (1 << 27, 6), (1 << 33, 7), (1 << 63, 8))
TILE, LEAF, FAN = 4096, 16, 8
PARTITION_ROWS = 400_000
_U = np.uint64


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the text's word shingles; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``fp``."""
    return add_columns(docs, [long_field("fp")], lambda b: [[fingerprint(x.as_py()) for x in b.column("text")]], keep)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> _U(shift)
    return rank


class GrayTree:
    """Index over fingerprints sorted by Gray rank; levels from the root groups down to single fingerprints."""

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        ones, zeros = [self.values], [~self.values]
        for size in (LEAF, *[FAN] * 64):
            if len(ones[0]) <= FAN:
                break
            edges = np.arange(0, len(ones[0]), size)
            ones.insert(0, np.bitwise_and.reduceat(ones[0], edges))
            zeros.insert(0, np.bitwise_and.reduceat(zeros[0], edges))
        # Bits that a node's fingerprints share, without those its parent shares already.
        self.fans = [1] * len(ones)
        self.masks, self.patterns = [], []
        for level, (one, zero) in enumerate(zip(ones, zeros, strict=True)):
            shared = one | zero
            if level:
                fan = LEAF if level == len(ones) - 1 else FAN
                self.fans[level] = fan
                above = (ones[level - 1] | zeros[level - 1])[np.arange(len(one)) // fan]
                shared &= ~above
            self.masks.append(shared)
            self.patterns.append(one)

    def within(self, lo: int, hi: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i in [lo, hi), of places whose values differ in at most ``bits`` bits."""
        count = len(self.masks[0])
        query = np.repeat(np.arange(lo, hi), count)
        node = np.tile(np.arange(count), hi - lo)
        spent = np.zeros(len(query), np.int64)
        for level, (mask, pattern) in enumerate(zip(self.masks, self.patterns, strict=True)):
            if level:
                fan = self.fans[level]
                query, spent = np.repeat(query, fan), np.repeat(spent, fan)
                node = (np.repeat(node * fan, fan).reshape(-1, fan) + np.arange(fan)).reshape(-1)
                there = node < len(mask)
                query, node, spent = query[there], node[there], spent[there]
            spent = spent + np.bitwise_count((self.values[query] ^ pattern[node]) & mask[node])
            near = spent <= bits
            query, node, spent = query[near], node[near], spent[near]
        return query, node


def smallest_linked(values: np.ndarray, bits: int = BITS, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value of its component) under links of at most ``bits`` bits, for distinct unsigned values."""
    tree = GrayTree(values)
    place = np.arange(len(tree.values))
    for lo in range(0, len(place), step):
        i, j = tree.within(lo, min(lo + step, len(place)), bits)
        later = i < j
        i, j = i[later], j[later]
        while len(i):
            a, b = place[i], place[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(place, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = place[place]
                if (up == place).all():
                    break
                place = up
    low = np.full(len(place), np.iinfo(np.int64).max)
    signed = tree.values.view(np.int64)
    np.minimum.at(low, place, signed)
    return signed, low[place]


def part_masks(parts: int) -> list[int]:
    edges = [64 * k // parts for k in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def local_links(distinct: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """(a, b), b < a: links within buckets that connect whatever is connected there."""
    parts = next(p for most, p in PARTS if n <= most) + max(0, bits - BITS)
    masks = part_masks(parts)
    chosen = [sum(masks[k] for k in some) for some in combinations(range(parts), parts - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    keys = F.array(*[F.struct(F.lit(t).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])
    dealt = distinct.select("fp", F.inline(keys))
    sizes = dealt.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    cells = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(own, t).alias("x"), F.greatest(own, t).alias("y")))
    met = dealt.join(sizes, ["way", "key"]).select("fp", "way", "key", F.inline(cells))
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(chosen) // PARTITION_ROWS))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        fp, way, key, x, y = (rows.column(c).to_numpy() for c in ("fp", "way", "key", "x", "y"))
        order = np.lexsort((y, x, key, way))
        fp, way, key, x, y = fp[order], way[order], key[order], x[order], y[order]
        new = (np.diff(way) != 0) | (np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)
        edges = np.concatenate(([0], np.flatnonzero(new) + 1, [len(fp)]))
        a, b = [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo > 1:
                value, low = smallest_linked(fp[lo:hi].view(np.uint64), bits)
                linked = value != low
                a.append(value[linked])
                b.append(low[linked])
        none = [np.empty(0, np.int64)]
        pairs = np.unique(np.stack([np.concatenate(a or none), np.concatenate(b or none)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return met.repartition(tasks, "way", "key", "x", "y").mapInArrow(search, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node is connected with, itself excluded where it is the root.

    Large-star links a node's larger neighbours, small-star its smaller ones, to the smallest of all; stars are what is
    left when neither changes anything.
    """
    edges, before = materialize(links.where("a <> b"), "links"), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        )
        edges = materialize(small.where("a <> b").distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def classes(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, root, component_id) from a stored table (doc_id, fp): the smallest doc_id reachable from each fingerprint."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    n = distinct.count()
    roots = components(local_links(distinct.select("fp"), n, bits))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return placed.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    A missing or empty text has fingerprint zero and links like any other.  A row without doc_id links too, but never
    names a component; ``component_id`` is null where no row of the component has an id.
    """
    prints = materialize(fingerprints(docs.select("doc_id", "text"), ["doc_id"]), "fingerprints")
    return prints.join(classes(prints, bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of ``docs`` for each component: the one whose doc_id names it.

    Where several rows of a component have that id, one of them stays.  Rows without doc_id cannot be told apart and all
    stay.
    """
    prints = materialize(fingerprints(docs.select("doc_id", "text"), ["doc_id"]), "fingerprints")
    named = prints.join(classes(prints, bits), "fp").where(F.col("doc_id") == F.col("component_id"))
    rows = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    keepers = materialize(named.groupBy("doc_id", "fp", "root").agg(F.lit(1)).join(rows, "doc_id").select("doc_id", "fp", "root", "_rows"), "keepers")
    single = docs.join(keepers.where("_rows = 1").select("doc_id"), "doc_id", "left_semi")
    kept = single.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
    several = keepers.where("_rows > 1").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), F.col("root").alias("_root"))
    if several.isEmpty():
        return kept
    # Ids of more than one row: the fingerprint tells the rows apart.
    own = {c: f"_own_{c}" for c in docs.columns if c == "fp"}
    marked = fingerprints(docs.withColumnsRenamed(own).join(several.select(F.col("_id").alias("doc_id")).distinct(), "doc_id", "left_semi"), list(docs.withColumnsRenamed(own).columns))
    chosen = marked.join(several, (F.col("doc_id") == F.col("_id")) & (F.col("fp") == F.col("_fp"))).dropDuplicates(["_root"])
    return kept.unionByName(chosen.drop("fp").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns))
