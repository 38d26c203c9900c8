"""Shared by the corpus operators: reading, row-wise Arrow steps, text buffers, and blocks of documents.

White space is the six ASCII characters space, tab, line feed, vertical tab, form feed and carriage return; a word is
a run of anything else.  ``bytes.split()`` splits on exactly these.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def add_columns(
    rows: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list], keep: list[str] | None = None
) -> DataFrame:
    """``rows`` with the columns ``fields`` that ``compute`` derives from each Arrow batch; ``keep`` names what else stays.

    ``compute`` returns a list of values per field, one for each row.  Columns of ``rows`` that are called like a new
    one are replaced.  Rows are neither shuffled nor reordered.
    """
    new = T.StructType(fields)
    kept = [c for c in (rows.columns if keep is None else keep) if c not in new.names]
    schema = T.StructType([rows.schema[c] for c in kept] + fields)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(v, k) for v, k in zip(compute(batch), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=kept + new.names)

    return rows.mapInArrow(step, schema)


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def text_field(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


# ---- text as numpy buffers -------------------------------------------------------------------------------------


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row starts (one more entry than rows); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("").cast(pa.large_string())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), starts


def chunks(starts: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about ``size`` bytes, one row at least."""
    at, end = 0, len(starts) - 1
    while at < end:
        upto = int(np.searchsorted(starts, starts[at] + size, side="right")) - 1
        upto = min(max(upto, at + 1), end)
        yield at, upto
        at = upto


ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words (two rounds of shift and multiply)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_BYTES = scramble(np.arange(1, 257, dtype=np.uint64) * ODD)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """Words of a range of rows: byte range, two 64-bit values, and the first word of every row."""

    lo: np.ndarray
    hi: np.ndarray
    value: np.ndarray
    other: np.ndarray
    first: np.ndarray


LANES = 8


class WordKeys:
    """Random keys for one job: words are told apart by two keyed 64-bit values.

    A value is the sum of products of key-shifted 32-bit halves of the word (NH hashing): two different words have equal
    sums with a chance of 2**-32 at most for each of the two, whatever the words are.  Words above 64 bytes take a keyed
    128-bit BLAKE2 digest instead.
    """

    def __init__(self, secret: bytes):
        self.secret = secret
        drawn = np.frombuffer(hashlib.shake_256(secret).digest(8 * 2 * (2 * LANES + 1)), "<u8").reshape(2, -1)
        self.length, self.lanes = drawn[:, 0] | _U(1), drawn[:, 1:] & _U(0xFFFFFFFF)

    def values(self, part: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        size = hi - lo
        eight = np.ndarray(len(part), "<u8", np.concatenate([part, np.zeros(8, np.uint8)]), strides=(1,))
        half, every = _U(32), _U(0xFFFFFFFF)
        sums = [size.astype(np.uint64) * k for k in self.length]
        for lane in range(LANES):
            at = np.flatnonzero(size > 8 * lane) if lane else np.arange(len(lo))
            if not len(at):
                break
            bits = eight[lo[at] + 8 * lane] & _FIRST_BYTES[np.minimum(size[at] - 8 * lane, 8)]
            low, high = bits & every, bits >> half
            for total, keys in zip(sums, self.lanes, strict=True):
                total[at] += (low + keys[2 * lane] & every) * (high + keys[2 * lane + 1] & every)
        for k in np.flatnonzero(size > 8 * LANES).tolist():
            digest = hashlib.blake2b(part[lo[k] : hi[k]].tobytes(), digest_size=16, key=self.secret).digest()
            sums[0][k], sums[1][k] = np.frombuffer(digest, "<u8")
        return [scramble(sums[0]), scramble(sums[1] ^ _U(0x5851F42D4C957F2D))]


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words_of(data: np.ndarray, starts: np.ndarray, keys: WordKeys) -> Words:
    """``starts`` are positions in ``data``, one more than rows.  Row borders end words."""
    base, end = int(starts[0]), int(starts[-1])
    part = data[base:end]
    n = len(part)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, np.uint64), np.empty(0, np.uint64), np.zeros(len(starts), np.int64))
    solid = ~_SPACE[part]
    new_row = np.zeros(n + 1, bool)
    new_row[starts - base] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | new_row[1:n]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | new_row[1:n]
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(lo + base, hi + base, *keys.values(part, lo, hi), np.searchsorted(lo, starts - base))


def runs_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial value of every ``width`` consecutive entries, by doubling."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    out, got, part, size, factor = None, 0, values, 1, ODD
    left = width
    while left:
        if left & 1:
            if out is None:
                out, got = part, size
            else:
                m = min(len(out), len(part) - got)
                out, got = out[:m] * factor + part[got : got + m], got + size
        left >>= 1
        if left:
            part = part[:-size] * factor + part[size:]
            factor = _U(int(factor) ** 2 % (1 << 64))
            size *= 2
    return out[: n - width + 1]


# ---- sorted numbers and bits as small binaries ------------------------------------------------------------------


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers: differences, byte by byte plane, compressed."""
    if len(values) == 0:
        return b""
    gaps = np.diff(values, prepend=_U(0)).astype("<u8")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    used = [p for p in range(8) if planes[p].any()] or [0]
    body = planes[: used[-1] + 1].tobytes()
    return bytes([used[-1] + 1]) + len(values).to_bytes(5, "little") + pack_bytes(body)


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    height, n = blob[0], int.from_bytes(blob[1:6], "little")
    planes = np.frombuffer(unpack_bytes(blob[6:]), np.uint8).reshape(height, n)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :height] = planes.T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def pack_bytes(body: bytes) -> bytes:
    return len(body).to_bytes(6, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack_bytes(blob: bytes) -> bytes:
    return pa.decompress(blob[6:], decompressed_size=int.from_bytes(blob[:6], "little"), codec="zstd", asbytes=True)


def pack_longs(values: np.ndarray) -> bytes:
    """Signed numbers in any order: byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return pack_bytes(planes.tobytes())


def unpack_longs(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack_bytes(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8")


def pack_bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(5, "little") + np.packbits(flags).tobytes()


def unpack_bits(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:5], "little")
    return np.unpackbits(np.frombuffer(blob, np.uint8, offset=5), count=n).astype(bool)


# ---- blocks of documents -----------------------------------------------------------------------------------------


@dataclass
class Layout:
    """Documents are dealt to ``blocks`` by a hash of their id and text, hash values to ``segments`` by range."""

    rows: int
    size: int
    blocks: int
    segments: int


def layout(docs: DataFrame) -> Layout:
    """Blocks of about 4 MB, so one fits a Python worker many times over; more and smaller ones while tasks would idle."""
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(got.b / BLOCK_BYTES), min(tasks, math.ceil(got.b / (BLOCK_BYTES >> 4))), 1)
    segments = max(math.ceil(got.b / BLOCK_BYTES), min(tasks, math.ceil(got.b / (BLOCK_BYTES >> 2))), 1)
    return Layout(got.n, got.b, blocks, segments)


def in_blocks(docs: DataFrame, plan: Layout) -> DataFrame:
    """(block, doc_id, text) of every row; different texts of one id, or without an id, spread over the blocks."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.blocks)).alias("block"), "doc_id", "text")


def segment_bounds(values: np.ndarray, segments: int, space: int) -> np.ndarray:
    """Where each segment starts in ascending ``values`` below ``space``."""
    edges = [space * s // segments for s in range(1, segments)]
    return np.concatenate(([0], np.searchsorted(values, np.array(edges, np.uint64)), [len(values)])).astype(np.int64)


NO_ID = np.iinfo(np.int64).max


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Document ids as numbers; a missing id comes after all others."""
    return column.combine_chunks().cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def document_order(docs: pa.Table) -> pa.Array:
    """Places of a block's rows by (doc_id, text), so that every read of the block numbers them alike."""
    keys = pa.table({"id": pa.array(ids_of(docs.column("doc_id"))), "text": docs.column("text")})
    return pc.sort_indices(keys, sort_keys=[("id", "ascending"), ("text", "ascending")])


def covered(flags: np.ndarray, width: int) -> np.ndarray:
    """Positions within ``width`` after a flagged start (the start included)."""
    edge = np.zeros(len(flags) + 1, np.int32)
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + width, len(flags)), -1)
    return np.cumsum(edge[:-1]) > 0
