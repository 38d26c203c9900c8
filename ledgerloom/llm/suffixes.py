"""Suffix-array dedup of byte strings, sorted deep-shallow.

A string of ``WIDTH`` bytes that occurs in two documents has the same smallest 26-byte gram in both (its anchor), so only
suffixes whose anchor occurs in two documents need sorting.

1. Each block of documents sends its anchors as compressed numbers; segments tell it which occur in two documents, and which
   are hot, that is, occur in more than ``HOT_BLOCKS`` blocks.
2. A block cuts its texts into stretches of suffixes with one such anchor and sends each different stretch once, with the
   smallest doc_id that has it, to the anchor's segment.  Under a hot anchor (the border of a passage that very many documents
   share) stretches differ with what surrounds the passage, so they are cut into single strings of ``WIDTH`` bytes that go to
   the segments of their own hashes: no segment gets more than ``HOT_BLOCKS`` blocks' stretches of an anchor, and of a string
   one entry a block.
3. A segment sorts the suffixes of its stretches deep-shallow: multikey quicksort, eight bytes a symbol, to a shallow
   depth; the groups that still tie there are ordered by blind tries, built top-down and breadth-first: a node skips to the
   first byte in which its suffixes differ and branches on that byte alone.  Suffixes that tie to ``WIDTH`` bytes are equal
   strings; the segment tells each block which suffixes of its stretches start in a smaller document.
4. A block removes the bytes under those suffixes, and under all suffixes of a stretch it holds in a smaller document.

The text is dealt once and read three times from the same exchange.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import (
    Layout, _BYTES, chunks, covered, document_order, ids_of, in_blocks, layout, pack_bits, pack_bytes, pack_longs, pack_sorted, runs_hash, scramble,
    unpack_bits, unpack_bytes, unpack_longs, unpack_sorted, utf8,
)
from ledgerloom.llm.windows import SENT, TOLD, _answers, _cut, _sent, _told, repeated

WIDTH = 50
GRAM = 26
SHALLOW = 16
HOT_BLOCKS = 256
_U = np.uint64
ANCHORS, STRETCHES, HOT = 0, 1, 2


# ---- the sort ----------------------------------------------------------------------------------------------------


def symbols(pool: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; positions past the end count as zero bytes."""
    wide = np.concatenate([pool, np.zeros(64, np.uint8)]).astype(np.uint64)
    out = wide[: len(pool) + 56] << _U(56)
    for k in range(1, 8):
        out |= wide[k : len(pool) + 56 + k] << _U(56 - 8 * k)
    return out


def _ties(group: np.ndarray) -> np.ndarray:
    """Which entries of an ascending group column share their group with a neighbour."""
    same = group[1:] == group[:-1]
    out = np.zeros(len(group), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _split(order: np.ndarray, group: np.ndarray, part: np.ndarray, keys: np.ndarray) -> None:
    """Reorders the tied entries ``part`` inside their groups by ``keys`` and gives unequal ones groups of their own.

    A group's number is the place of its first entry, so splitting one changes no other.
    """
    within = np.lexsort((keys, group[part])) if group[part[0]] != group[part[-1]] else np.argsort(keys, kind="stable")
    order[part] = order[part][within]
    keys, groups = keys[within], group[part][within]
    new = np.ones(len(part), bool)
    new[1:] = (groups[1:] != groups[:-1]) | (keys[1:] != keys[:-1])
    group[part] = part[np.flatnonzero(new)[np.cumsum(new) - 1]]


def deep_shallow(words: np.ndarray, starts: np.ndarray, width: int = WIDTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and groups of equal ``width``-byte strings: (order of ``starts``, group of each place in it)."""
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, shallow, 8):
        part = np.flatnonzero(_ties(group))
        if not len(part):
            return order, group
        _split(order, group, part, words[starts[order[part]] + depth])
    # Blind tries on what still ties: all groups at once, a level of every trie in each round.  ``depth`` is how far the
    # suffixes of a node are known to agree; it grows in every round.
    part = np.flatnonzero(_ties(group))
    depth = np.full(len(part), min(shallow, width), np.int64)
    while len(part):
        at, groups = starts[order[part]], group[part]
        heads = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        sizes = np.diff(np.append(heads, len(part)))
        pattern = np.repeat(at[heads], sizes)
        differs = depth + first_byte(words[at + depth] ^ words[pattern + depth])
        skip = np.repeat(np.minimum.reduceat(differs, heads), sizes)
        # Nodes whose next eight bytes agree only go deeper; the others branch on the byte they skip to.
        branching = (skip < depth + 8) & (skip < width)
        if branching.any():
            _split(order, group, part[branching], words[(at + skip)[branching]] >> _U(56))
        depth = np.where(branching, skip + 1, skip)
        left = (depth < width) & _ties(group[part])
        part, depth = part[left], depth[left]
    return order, group


def first_byte(odd: np.ndarray) -> np.ndarray:
    """Place of the highest byte that is not zero, 8 where all are.  Halves of 32 bits are exact as floating-point numbers."""
    high = odd >> _U(32)
    bits = np.frexp(np.where(high, high, odd & _U(0xFFFFFFFF)).astype(np.float64))[1]
    return (32 - bits) // 8 + np.where(high, 0, 4)


# ---- blocks ------------------------------------------------------------------------------------------------------


class BlockSuffixes:
    """Suffixes of a block's documents that have ``width`` bytes left, in runs of one anchor: (document, start, end, anchor)."""

    def __init__(self, docs: pa.Table, width: int, gram: int, bits: int):
        self.docs = docs.take(document_order(docs))
        self.ids = ids_of(self.docs.column("doc_id"))
        self.data, self.starts = utf8(self.docs.column("text"))
        doc, lo, hi, anchor = [], [], [], []
        for a, b in chunks(self.starts):
            base, end = int(self.starts[a]), int(self.starts[b])
            if end - base < width:
                continue
            least = scramble(runs_hash(_BYTES[self.data[base:end]], gram))
            size, span = 1, width - gram + 1
            while 2 * size <= span:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < span:
                least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
            owner = np.repeat(np.arange(a, b), np.diff(self.starts[a : b + 1]))
            whole = owner[: len(least)] == owner[width - 1 :]
            new = whole.copy()
            new[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
            first = np.flatnonzero(new)
            stop = np.flatnonzero(whole & ~np.append(whole[1:] & ~new[1:], False)) + 1
            doc.append(owner[first])
            lo.append(first + base)
            hi.append(stop + base)
            anchor.append(scramble(least[first] ^ _U(0x2545F4914F6CDD1D)) >> _U(64 - bits))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.doc, self.lo, self.hi = join(doc, np.int64), join(lo, np.int64), join(hi, np.int64)
        self.anchor = join(anchor, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different anchors, whether each occurs in two documents of the block, and the anchor number of each run."""
        order = np.argsort(self.anchor, kind="stable")
        ascending, doc = self.anchor[order], self.doc[order]
        heads = np.flatnonzero(np.concatenate(([True], ascending[1:] != ascending[:-1]))) if len(order) else order
        sizes = np.diff(np.append(heads, len(order)))
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(heads)), sizes)
        # Runs are in document order, so the first and the last of an anchor tell whether it has two documents.
        return ascending[heads], doc[heads] < doc[heads + sizes - 1], place

    def narrow(self, told: dict[int, np.ndarray], width: int, bits: int) -> None:
        """Keeps the runs of shared anchors, those of hot ones cut into single strings under their own hashes."""
        values, _, place = self.anchors()
        none = np.zeros(len(values), bool)
        shared, hot = told.get(ANCHORS, none)[place], told.get(HOT, none)[place]
        cold, warm = np.flatnonzero(shared & ~hot), np.flatnonzero(shared & hot)
        doc, lo, hi, anchor = self.doc[cold], self.lo[cold], self.hi[cold], self.anchor[cold]
        if len(warm):
            n = (self.hi - self.lo)[warm]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            size = n + width - 1
            ends = zip(self.lo[warm].tolist(), (self.hi[warm] + width - 1).tolist(), strict=True)
            pool = np.concatenate([self.data[a:b] for a, b in ends])
            strings = scramble(runs_hash(_BYTES[pool], width)) >> _U(64 - bits)
            at = np.repeat(self.lo[warm], n) + inside
            doc, lo, hi = np.append(doc, np.repeat(self.doc[warm], n)), np.append(lo, at), np.append(hi, at + 1)
            anchor = np.append(anchor, strings[np.repeat(np.cumsum(size) - size, n) + inside])
        order = np.argsort(lo, kind="stable")
        self.doc, self.lo, self.hi, self.anchor = doc[order], lo[order], hi[order], anchor[order]

    def stretches(self, width: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Different stretches by (anchor, text): texts, anchors, first run of each; and the stretch of each run.

        A document's number in the block follows its id and text, so every read numbers stretches alike, and the first run of
        a stretch is in the smallest document.
        """
        runs = np.argsort(self.anchor, kind="stable")
        number: dict[bytes, int] = {}
        of, first, last = np.empty(len(self.lo), np.int64), [], -1
        data = self.data
        for r, p, a, b in zip(runs.tolist(), self.anchor[runs].tolist(), self.lo[runs].tolist(), self.hi[runs].tolist(), strict=True):
            if p != last:
                number, last = {}, p
            text = data[a : b + width - 1].tobytes()
            k = number.get(text)
            if k is None:
                k = number[text] = len(first)
                first.append((r, text))
            of[r] = k
        first_run = np.array([r for r, _ in first], np.int64)
        return [t for _, t in first], self.anchor[first_run], first_run, of


def anchor_bits(plan: Layout) -> int:
    """Enough bits that two different anchors seldom fall together; if they do, the sort tells them apart."""
    return min(63, max(24, math.ceil(math.log2(plan.size + 1)) + 13))


def blocks_of(keys: list[np.ndarray]) -> list[np.ndarray]:
    """For lists of ascending distinct keys: in how many lists each one occurs."""
    values, counts = np.unique(np.concatenate(keys), return_counts=True)
    return [counts[np.searchsorted(values, k)] for k in keys]


def remove_repeated_strings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``; ``kept`` holds the bytes left.

    A byte goes if a string of ``width`` bytes that covers it also starts in a document with a smaller doc_id, judged on
    the input.  Texts are UTF-8 bytes; a missing text is empty.  Rows without doc_id come after all others; rows with
    the same doc_id do not remove anything from each other.  ``hot_blocks`` changes the plan, never the rows.
    """
    plan = layout(docs)
    bits = anchor_bits(plan)
    dealt = in_blocks(docs, plan)

    def send_anchors(key: tuple, rows: pa.Table) -> pa.Table:
        values, twice, _ = BlockSuffixes(rows, width, gram, bits).anchors()
        cuts = _cut(values, plan, 1 << bits)
        return _sent(key[0].as_py(), [(ANCHORS, s, pack_sorted(values[a:b]), pack_bits(twice[a:b])) for s, a, b in cuts])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        keys, segment, blocks = [unpack_sorted(x.as_py()) for x in rows.column("keys")], key[1].as_py(), rows.column("block").to_pylist()
        found = repeated(keys, [unpack_bits(x.as_py()) for x in rows.column("more")])
        answers = [_answers(segment, ANCHORS, blocks, [pack_bits(f) for f in found])]
        if len(keys) > hot_blocks:
            answers.append(_answers(segment, HOT, blocks, [pack_bits(n > hot_blocks) for n in blocks_of(keys)]))
        else:
            answers.append(_answers(segment, HOT, blocks, [pack_bits(np.zeros(len(k), bool)) for k in keys]))
        return pa.concat_tables(answers)

    def send_stretches(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sent(0, [])
        block = BlockSuffixes(rows, width, gram, bits)
        block.narrow(_told(told), width, bits)
        texts, anchors, first, _ = block.stretches(width)
        lowest = block.ids[block.doc[first]]
        out = []
        for s, a, b in _cut(anchors, plan, 1 << bits):
            sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
            head = pack_longs(np.stack([sizes, lowest[a:b]]).reshape(-1))
            out.append((STRETCHES, s, head, pack_bytes(b"".join(texts[a:b]))))
        return _sent(key[0].as_py(), out)

    def sort(key: tuple, rows: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        owners, stretches, counts = [], [], []
        for k, m in zip(rows.column("keys").to_pylist(), rows.column("more").to_pylist(), strict=True):
            n, d = unpack_longs(k).reshape(2, -1)
            text, end = unpack_bytes(m), np.cumsum(n)
            # A stretch that several blocks sent is sorted once.
            stretches.append(np.fromiter((number.setdefault(text[a:b], len(number)) for a, b in zip((end - n).tolist(), end.tolist(), strict=True)), np.int64, len(n)))
            owners.append(d)
            counts.append(int((n - width + 1).sum()))
        stretch, owner = np.concatenate(stretches), np.concatenate(owners)
        size = np.fromiter(map(len, number), np.int64, len(number))
        words = symbols(np.frombuffer(b"".join(number), np.uint8))
        first = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(first, stretch, owner)
        n = size - width + 1
        begin = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(begin, n)
        order, group = deep_shallow(words, np.repeat(np.cumsum(size) - size, n) + inside, width)
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        lowest = np.empty(len(order), np.int64)
        lowest[order] = np.repeat(np.minimum.reduceat(np.repeat(first, n)[order], heads), np.diff(np.append(heads, len(order))))
        # Back to all that was sent: each block hears about its own copy of a stretch.
        n = n[stretch]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        earlier = lowest[np.repeat(begin[stretch], n) + inside] < np.repeat(owner, n)
        parts = np.split(earlier, np.cumsum(counts)[:-1])
        return _answers(key[1].as_py(), STRETCHES, rows.column("block").to_pylist(), [pack_bits(p) for p in parts])

    def finish(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        block, answers = BlockSuffixes(rows, width, gram, bits), _told(told)
        block.narrow(answers, width, bits)
        _, _, first, of = block.stretches(width)
        earlier = answers.get(STRETCHES, np.empty(0, bool))
        marked = np.zeros(len(block.data) + 1, bool)
        length = block.hi[first] - block.lo[first]
        offset = np.cumsum(length) - length
        n = block.hi - block.lo
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        # A stretch that the block has in a smaller document goes whole.
        late = block.ids[block.doc] > block.ids[block.doc[first[of]]]
        goes = np.repeat(late, n)
        goes |= earlier[np.repeat(offset[of], n) + inside] if len(earlier) else False
        marked[(np.repeat(block.lo, n) + inside)[goes]] = True
        removed, spans, digests, kept, sizes = [], [], [], [], []
        for i in range(len(block.ids)):
            a, b = int(block.starts[i]), int(block.starts[i + 1])
            gone = covered(marked[a:b], width)
            left = block.data[a:b][~gone].tobytes()
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
            sizes.append(b - a)
        return pa.table(
            [block.docs.column("doc_id").cast(kinds[0]), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=names,
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    result = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, "
        "kept_sha256 string, kept binary"
    )
    sent = dealt.groupBy("block").applyInArrow(send_anchors, SENT)
    shared = sent.groupBy("row", "segment").applyInArrow(merge, TOLD)
    stretches = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_stretches, SENT)
    sorted_ = stretches.groupBy("row", "segment").applyInArrow(sort, TOLD)
    return dealt.groupBy("block").cogroup(shared.unionByName(sorted_).groupBy("block")).applyInArrow(finish, result)


def string_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``remove_repeated_strings`` without the bytes left: nulls are empty, ids that tie or are missing as there.

    Texts are judged whole, however long; a text takes a multiple of its size in one task.  An empty table gives no rows.
    """
    return remove_repeated_strings(docs, width).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
