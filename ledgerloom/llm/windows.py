"""Substring dedup on windows of words, with a count-min prefilter.

Documents are dealt to blocks by id, sketch cells and window hashes to segments by range.

1. Each block sketches its windows: in every row of a count-min sketch a window falls into one cell.  What a block sends is
   its partition sketch, the cells it fills and whether it fills them twice, as compressed cell numbers.
2. A segment merges the partition sketches of its range and tells each block which of its cells hold two or more windows.
   A merged count is never below a window's true count.
3. A block sends the windows that all rows of the sketch call repeated, each once, with its own first occurrence.
4. A segment groups these by 96 bits, 64 and 32 of them from independent values of each word's bytes under random keys of the
   job, and tells each block whether its first occurrence is the first of all.
5. A block removes all words under a window that is not the first of its kind.

The text is dealt once and read three times from the same exchange; only sketches, hashes and single bits travel besides.
"""

from __future__ import annotations

import hashlib
import math
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import (
    Layout, WordKeys, chunks, covered, document_order, ids_of, in_blocks, layout, pack_bits, pack_longs, pack_sorted, runs_hash, scramble,
    segment_bounds, unpack_bits, unpack_bytes, unpack_longs, unpack_sorted, pack_bytes, utf8, words_of,
)

WIDTH = 20
ROWS, CELLS_PER_BYTE = 2, 1.0
_U = np.uint64
SENT = "block long, row int, segment long, keys binary, more binary"
TOLD = "block long, row int, segment long, bits binary"


class BlockWindows:
    """All windows of a block, in document order (doc_id, then text): hashes, document, first word."""

    def __init__(self, docs: pa.Table, width: int, keys: WordKeys):
        self.docs = docs.take(document_order(docs))
        self.ids = ids_of(self.docs.column("doc_id"))
        self.width = width
        self.data, self.starts = utf8(self.docs.column("text"))
        hashes, second, doc, at, counts, self.lo, self.hi = [], [], [], [], [], [], []
        for a, b in chunks(self.starts):
            words = words_of(self.data, self.starts[a : b + 1], keys)
            n = np.diff(words.first)
            counts.append(n)
            self.lo.append(words.lo)
            self.hi.append(words.hi)
            if len(words.value) < width:
                continue
            owner = np.repeat(np.arange(a, b), n)
            place = np.arange(len(owner)) - np.repeat(words.first[:-1], n)
            whole = owner[: len(owner) - width + 1] == owner[width - 1 :]
            hashes.append(scramble(runs_hash(words.value, width))[whole])
            second.append((scramble(runs_hash(words.other, width))[whole] >> _U(32)).astype(np.uint32))
            doc.append(owner[: len(whole)][whole].astype(np.int32))
            at.append(place[: len(whole)][whole].astype(np.int32))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.hash, self.doc, self.at = join(hashes, np.uint64), join(doc, np.int32), join(at, np.int32)
        self.second = join(second, np.uint32)
        self.n_words = join(counts, np.int64)
        self.lo, self.hi = join(self.lo, np.int64), join(self.hi, np.int64)

    def cells(self, row: int, bits: int) -> np.ndarray:
        return scramble(self.hash + _U((row + 1) * 0xA24BAED4963EE407 % (1 << 64))) >> _U(64 - bits)


def sketch_bits(plan: Layout) -> int:
    """Cells of a sketch row, as a power of two: about one a byte of text, so some five to ten a window."""
    return max(10, math.ceil(math.log2(max(plan.size * CELLS_PER_BYTE, 1))))


def _cut(values: np.ndarray, plan: Layout, space: int) -> list[tuple[int, int, int]]:
    """(segment, from, to) of ascending values, empty ones left out."""
    edges = segment_bounds(values, plan.segments, space)
    return [(s, int(edges[s]), int(edges[s + 1])) for s in np.flatnonzero(np.diff(edges)).tolist()]


def _told(rows: pa.Table) -> dict[int, np.ndarray]:
    """Bits sent back to a block, joined over the segments, by sketch row."""
    listed = sorted(zip(rows.column("row").to_pylist(), rows.column("segment").to_pylist(), rows.column("bits").to_pylist(), strict=True))
    out: dict[int, list[np.ndarray]] = {}
    for row, _, bits in listed:
        out.setdefault(row, []).append(unpack_bits(bits))
    return {row: np.concatenate(parts) for row, parts in out.items()}


def _sent(block: int, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table(
        [pa.array([block] * len(rows), pa.int64()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
         pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
        names=["block", "row", "segment", "keys", "more"],
    )


def _answers(segment: int, row: int, blocks: list[int], bits: list[bytes]) -> pa.Table:
    n = len(blocks)
    return pa.table(
        [pa.array(blocks, pa.int64()), pa.array([row] * n, pa.int32()), pa.array([segment] * n, pa.int64()), pa.array(bits, pa.binary())],
        names=["block", "row", "segment", "bits"],
    )


def repeated(keys: list[np.ndarray], twice: list[np.ndarray]) -> list[np.ndarray]:
    """For lists of ascending distinct keys: which of them occur in two lists, or twice in one."""
    pool = np.concatenate(keys)
    pool.sort()
    again = pool[1:][pool[1:] == pool[:-1]]
    again = np.union1d(again, np.concatenate([k[t] for k, t in zip(keys, twice, strict=True)]))
    if not len(again):
        return [np.zeros(len(k), bool) for k in keys]
    return [again[np.minimum(np.searchsorted(again, k), len(again) - 1)] == k for k in keys]


def candidate_keys(block: BlockWindows, told: dict[int, np.ndarray], bits: int) -> tuple[np.ndarray, ...]:
    """Windows estimated repeated, one entry for each kind: (hash, 32 bits of another hash, first window of it), by hash.

    The fourth result gives the entry of every window, -1 for those not estimated repeated.
    """
    likely = np.ones(len(block.hash), bool)
    for row in range(ROWS):
        cells, place = np.unique(block.cells(row, bits), return_inverse=True)
        likely &= told.get(row, np.zeros(len(cells), bool))[place]
    at = np.flatnonzero(likely)
    # Rows with the same id count as one document, so the first window is the one with the earliest start in any of them.
    order = at[np.lexsort((block.at[at], block.ids[block.doc[at]], block.second[at], block.hash[at]))]
    hashes = block.hash[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (block.second[order][1:] != block.second[order][:-1])
    entry = np.full(len(block.hash), -1, np.int64)
    entry[order] = np.cumsum(new) - 1
    first = order[new]
    return hashes[new], block.second[first], first, entry


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row of ``docs``.

    A word goes if a window of ``width`` words that covers it also starts earlier (smaller doc_id, or same document and
    earlier start), judged on the input.  A missing or empty text has no words.  Rows without doc_id come after all
    others; rows with the same doc_id count as one document: what they share at the same place is not removed.
    """
    plan = layout(docs)
    bits = sketch_bits(plan)
    dealt = in_blocks(docs, plan)
    keys = WordKeys(secrets.token_bytes(32))

    def sketch(key: tuple, rows: pa.Table) -> pa.Table:
        block, out = BlockWindows(rows, width, keys), []
        for row in range(ROWS):
            cells, counts = np.unique(block.cells(row, bits), return_counts=True)
            out += [(row, s, pack_sorted(cells[a:b]), pack_bits(counts[a:b] > 1)) for s, a, b in _cut(cells, plan, 1 << bits)]
        return _sent(key[0].as_py(), out)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        row, segment = key[0].as_py(), key[1].as_py()
        found = repeated(
            [unpack_sorted(x.as_py()) for x in rows.column("keys")], [unpack_bits(x.as_py()) for x in rows.column("more")]
        )
        return _answers(segment, row, rows.column("block").to_pylist(), [pack_bits(f) for f in found])

    def choose(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sent(0, [])
        block = BlockWindows(rows, width, keys)
        hashes, second, first, _ = candidate_keys(block, _told(told), bits)
        out = []
        for s, a, b in _cut(hashes, plan, 1 << 64):
            at = first[a:b]
            more = b"".join(
                len(x).to_bytes(6, "little") + x
                for x in (pack_bytes(second[a:b].astype("<u4").tobytes()), pack_longs(block.ids[block.doc[at]]), pack_longs(block.at[at]))
            )
            out.append((ROWS, s, pack_sorted(hashes[a:b]), more))
        return _sent(key[0].as_py(), out)

    def group(key: tuple, rows: pa.Table) -> pa.Table:
        keys, seconds, ids, ats = [], [], [], []
        for k, m in zip(rows.column("keys").to_pylist(), rows.column("more").to_pylist(), strict=True):
            parts = []
            while m:
                size = int.from_bytes(m[:6], "little")
                parts.append(m[6 : 6 + size])
                m = m[6 + size :]
            keys.append(unpack_sorted(k))
            seconds.append(np.frombuffer(unpack_bytes(parts[0]), "<u4"))
            ids.append(unpack_longs(parts[1]))
            ats.append(unpack_longs(parts[2]))
        k, s, d, a = map(np.concatenate, (keys, seconds, ids, ats))
        order = np.lexsort((a, d, s, k))
        k, s, d, a = k[order], s[order], d[order], a[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        first = np.empty(len(k), bool)
        first[order] = (d == d[head]) & (a == a[head])
        edges = np.cumsum([len(x) for x in keys])[:-1]
        return _answers(key[1].as_py(), ROWS, rows.column("block").to_pylist(), [pack_bits(x) for x in np.split(first, edges)])

    def finish(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        block, answers = BlockWindows(rows, width, keys), _told(told)
        hashes, _, first, entry = candidate_keys(block, answers, bits)
        is_first = answers.get(ROWS, np.zeros(len(hashes), bool))
        own = np.where(entry >= 0, first[entry] if len(first) else 0, -1)
        same = (entry >= 0) & (block.ids[block.doc] == block.ids[block.doc[own]]) & (block.at == block.at[own])
        later = (entry >= 0) & ~(same & is_first[entry] if len(first) else same)
        offset = np.concatenate(([0], np.cumsum(block.n_words)))
        starts = np.zeros(int(offset[-1]), bool)
        starts[offset[block.doc[later]] + block.at[later]] = True
        removed, digests, texts = [], [], []
        data = block.data
        for i in range(len(block.n_words)):
            a, b = int(offset[i]), int(offset[i + 1])
            gone = covered(starts[a:b], width)
            removed.append(int(gone.sum()))
            left = np.flatnonzero(~gone) + a
            text = b" ".join(data[x:y].tobytes() for x, y in zip(block.lo[left].tolist(), block.hi[left].tolist(), strict=True))
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode())
        return pa.table(
            [block.docs.column("doc_id").cast(kinds[0]), pa.array(block.n_words, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=names,
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    result = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    sketched = dealt.groupBy("block").applyInArrow(sketch, SENT)
    estimated = sketched.groupBy("row", "segment").applyInArrow(merge, TOLD)
    chosen = dealt.groupBy("block").cogroup(estimated.groupBy("block")).applyInArrow(choose, SENT)
    grouped = chosen.groupBy("row", "segment").applyInArrow(group, TOLD)
    return dealt.groupBy("block").cogroup(estimated.unionByName(grouped).groupBy("block")).applyInArrow(finish, result)


def window_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``remove_repeated_windows`` without the words left: nulls are empty, ids that tie or are missing as there.

    Texts are judged whole, however long; a text takes a multiple of its size in one task.  An empty table gives no rows.
    """
    return remove_repeated_windows(docs, width).select("doc_id", F.col("n_words"), "n_removed", "kept_sha256")
