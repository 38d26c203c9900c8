"""Merkle manifest of a dataset, as a tree of SHA-256 midstates.

H is SHA-256 over the concatenated inputs, digests as 64 characters of hexadecimal text: exactly one block of the hash.  So
the state of a parent's hash before each child slot is eight 32-bit words, which the manifest keeps beside the digests.
Folding a replaced child resumes the copied state of its slot with the replacement and the siblings to the right; what
lies to the left is never read again.

1. Leaves are hashed by column functions, ranked inside their tree by a range sort (counts per sorted partition give the
   offsets), and cut into subtrees of ``ARITY ** HEIGHT`` consecutive leaves.
2. A task builds one subtree: the digests of all levels and the states before every slot, in one binary.  The roots of the
   subtrees are the leaves of the next round, until each tree has one; their roots form the tree of the whole.
3. Top-down, each subtree gets the path of its root: per level the slot, its state and the siblings.
4. A task folds the leaves of one subtree through the subtree's own states, then along that path.

Hot trees are cut like all others; nothing is collected, and a task sees one subtree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, UPPER
from ledgerloom.sources.store import materialize

ARITY, HEIGHT = 8, 4
CHUNK = 4096
_U = np.uint32


# ---- SHA-256 on many messages at once ----------------------------------------------------------------------------


def _root_bits(n: int, power: int) -> list[int]:
    """The first 32 fractional bits of the ``power``-th roots of the first ``n`` primes."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, p))][:n]
    out = []
    for p in primes:
        low, high = 0, 1 << 40
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if mid**power <= p << (32 * power) else (low, mid)
        out.append(low & 0xFFFFFFFF)
    return out


_FIRST = np.array(_root_bits(8, 2), _U)
_ROUND = [_U(k) for k in _root_bits(64, 3)]
_HEX = np.array([int.from_bytes(f"{b:02x}".encode(), "big") for b in range(256)], _U)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> _U(n)) | (x << _U(32 - n))


def _compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> _U(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> _U(10))))
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[i] + w[i]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + t, c, b, a, t + u
    return np.stack([a, b, c, d, e, f, g, h]) + state


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) each, in runs that stay in the cache."""
    n = state.shape[1]
    if n <= CHUNK:
        return _compress(state, block)
    return np.concatenate([_compress(state[:, k : k + CHUNK], block[:, k : k + CHUNK]) for k in range(0, n, CHUNK)], axis=1)


def first_states(n: int) -> np.ndarray:
    return np.repeat(_FIRST[:, None], n, axis=1)


def as_block(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as hexadecimal text, one block (16, n) each."""
    out = np.empty((16, digests.shape[1]), _U)
    out[0::2] = _HEX[digests >> _U(24)] << _U(16) | _HEX[digests >> _U(16) & _U(255)]
    out[1::2] = _HEX[digests >> _U(8) & _U(255)] << _U(16) | _HEX[digests & _U(255)]
    return out


def closed(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of so many whole blocks, from the states after them."""
    pad = np.zeros((16, state.shape[1]), _U)
    pad[0] = 0x80000000
    pad[15] = blocks * 512
    return compress(state, pad)


def to_bytes(digests: np.ndarray) -> bytes:
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()


def from_bytes(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, ">u4").reshape(-1, 8).T.astype(_U))


# ---- one subtree -------------------------------------------------------------------------------------------------


@dataclass
class Subtree:
    """Digests of every level, leaves first, and for every node but the root the parent's state before its slot."""

    digests: list[np.ndarray]
    before: list[np.ndarray]

    @classmethod
    def build(cls, leaves: np.ndarray, levels: int) -> Subtree:
        digests, before = [leaves], []
        for _ in range(levels):
            children = digests[-1]
            n = children.shape[1]
            states, kept = first_states(-(-n // ARITY)), np.empty_like(children)
            for slot in range(min(ARITY, n)):
                here = children[:, slot::ARITY]
                have = here.shape[1]
                kept[:, slot::ARITY] = states[:, :have]
                states[:, :have] = compress(states[:, :have], as_block(here))
            sizes = np.minimum(ARITY, n - ARITY * np.arange(states.shape[1]))
            digests.append(closed(states, sizes))
            before.append(kept)
        return cls(digests, before)

    def pack(self) -> bytes:
        head = [len(self.before), self.digests[0].shape[1]]
        return np.array(head, ">u4").tobytes() + b"".join(map(to_bytes, [*self.digests, *self.before]))

    @classmethod
    def unpack(cls, body: bytes) -> Subtree:
        levels, n = np.frombuffer(body, ">u4", 2).tolist()
        sizes = [n]
        for _ in range(levels):
            sizes.append(-(-sizes[-1] // ARITY))
        parts, at = [], 8
        for size in sizes + sizes[:-1]:
            parts.append(from_bytes(body[at : at + 32 * size]))
            at += 32 * size
        return cls(parts[: levels + 1], parts[levels + 1 :])

    def path(self, leaf: int) -> bytes:
        """Per level from ``leaf`` up to the root: slot, number of siblings in the run, state before the slot, the others."""
        out = []
        for nodes, before in zip(self.digests, self.before, strict=False):
            slot, low = leaf % ARITY, leaf - leaf % ARITY
            run = [k for k in range(low, min(low + ARITY, nodes.shape[1]))]
            out.append(bytes([slot, len(run)]) + to_bytes(before[:, leaf : leaf + 1]) + to_bytes(nodes[:, [k for k in run if k != leaf]]))
            leaf //= ARITY
        return b"".join(out)

    def fold(self, replaced: np.ndarray) -> np.ndarray:
        """Roots (8, n) after each leaf alone is replaced."""
        at, now = np.arange(replaced.shape[1]), replaced
        for nodes, before in zip(self.digests, self.before, strict=False):
            state = compress(before[:, at], as_block(now))
            blocks, sizes = as_block(nodes), np.minimum(ARITY, nodes.shape[1] - (at - at % ARITY))
            for step in range(1, ARITY):
                more = np.flatnonzero(at % ARITY + step < sizes)
                if not len(more):
                    break
                state[:, more] = compress(state[:, more], blocks[:, at[more] + step])
            now, at = closed(state, sizes), at // ARITY
        return now


def along(path: bytes, now: np.ndarray) -> np.ndarray:
    """Digests (8, n) that all sit at the foot of ``path``, folded to its top."""
    at = 0
    while at < len(path):
        slot, size = path[at], path[at + 1]
        state = from_bytes(path[at + 2 : at + 34])
        others = as_block(from_bytes(path[at + 34 : at + 34 + 32 * (size - 1)]))
        n = now.shape[1]
        state = compress(np.repeat(state, n, axis=1), as_block(now))
        for k in range(slot, size - 1):
            state = compress(state, np.repeat(others[:, k : k + 1], n, axis=1))
        now = closed(state, np.full(n, size))
        at += 34 + 32 * (size - 1)
    return now


def siblings(path: bytes) -> bytes:
    """Hexadecimal text of the others on a path, level by level, left to right."""
    out, at = [], 0
    while at < len(path):
        end = at + 34 + 32 * (path[at + 1] - 1)
        out.append(path[at + 34 : end].hex().encode())
        at = end
    return b"".join(out)


def proofs(tree: Subtree, above: bytes) -> list[str]:
    """SHA-256 of the siblings of every leaf, up to the root of the subtree and then ``above``."""
    others = []
    for nodes in tree.digests[:-1]:
        text = to_bytes(nodes).hex().encode()
        level = []
        for k in range(nodes.shape[1]):
            low = k - k % ARITY
            level.append(text[64 * low : 64 * k] + text[64 * (k + 1) : 64 * (low + ARITY)])
        others.append(level)
    out = []
    for leaf in range(tree.digests[0].shape[1]):
        got = hashlib.sha256()
        for level in others:
            got.update(level[leaf])
            leaf //= ARITY
        got.update(above)
        out.append(got.hexdigest())
    return out


# ---- the tree over tables ----------------------------------------------------------------------------------------


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, nr, leaf, tampered): digests of a row as it is and as tampering leaves it; ``nr`` tells equal rows apart."""
    head = F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = F.translate("text", UPPER, LOWER)
    digest = lambda text: F.unhex(F.sha2(F.concat(head, field(text)), 256))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", F.monotonically_increasing_id().alias("nr"),
        digest(F.col("text")).alias("leaf"), F.when(hit, digest(lower)).otherwise(digest(F.col("text"))).alias("tampered"),
    )


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``idx``, their place in their ``tree`` by ``order`` (which leaves no ties), and the tree's ``leaves``.

    One range sort; a tree that fills many sorted partitions gets its offsets from their counts.
    """
    sorted_ = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    stored = materialize(sorted_.withColumn("at", F.monotonically_increasing_id()), name)
    placed = stored.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("leaves")
    )
    return placed.join(offsets, ["tree", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "leaves")


def levels_of(leaves: int) -> int:
    levels = 0
    while ARITY**levels < leaves:
        levels += 1
    return levels


def in_subtrees(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / ARITY**HEIGHT).cast("long"))


SUBTREES = "tree string, block long, leaves long, root binary, body binary"
PATHS = "tree string, idx long, path binary"


def _stacked(column: pa.ChunkedArray) -> np.ndarray:
    return from_bytes(b"".join(column.to_pylist()))


def subtree_builder(done: int):
    """The step that builds one subtree whose leaves are ``done`` levels above the leaves of its tree."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        leaves = rows.column("leaves")[0].as_py()
        tree = Subtree.build(_stacked(rows.column("digest")), max(0, min(HEIGHT, levels_of(leaves) - done)))
        return pa.table(
            {"tree": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int64()), "leaves": pa.array([leaves], pa.int64()),
             "root": pa.array([to_bytes(tree.digests[-1])], pa.binary()), "body": pa.array([tree.pack()], pa.binary())}
        )

    return build


def grow(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Rounds of subtrees over (tree, idx, leaves, digest), each a written table; the last has one subtree a tree."""
    most, rounds = nodes.agg(F.max("leaves")).first()[0] or 0, []
    while not rounds or ARITY ** (HEIGHT * len(rounds)) < most:
        rows = in_subtrees(nodes).select("tree", "block", "idx", "leaves", "digest").groupBy("tree", "block")
        built = rows.applyInArrow(subtree_builder(HEIGHT * len(rounds)), SUBTREES)
        rounds.append(materialize(built, f"{name}-{len(rounds)}"))
        nodes = rounds[-1].select("tree", F.col("block").alias("idx"), "leaves", F.col("root").alias("digest"))
    return rounds


def _with_paths(subtrees: DataFrame, paths: DataFrame) -> DataFrame:
    """Subtrees with the path above their root; ``paths`` has (tree, idx, path) of the round above."""
    return subtrees.join(paths.withColumnRenamed("idx", "block"), ["tree", "block"])


def descend(rounds: list[DataFrame], tops: DataFrame, upto: int) -> DataFrame:
    """(tree, idx, path) of the nodes that round ``upto`` was built from, given the paths above the last round's roots."""

    def step(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tree = Subtree.unpack(row["body"])
                n, low = tree.digests[0].shape[1], row["block"] * ARITY**HEIGHT
                yield pa.RecordBatch.from_pydict(
                    {"tree": [row["tree"]] * n, "idx": pa.array(range(low, low + n), pa.int64()),
                     "path": pa.array([tree.path(k) + row["path"] for k in range(n)], pa.binary())}
                )

    paths = tops
    for subtrees in reversed(rounds[upto:]):
        paths = _with_paths(subtrees.select("tree", "block", "body"), paths).mapInArrow(step, PATHS)
    return paths


def manifest(docs: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Ranked leaves, the rounds of subtrees of the languages, and those of the tree over their roots; all written tables."""
    leaves = materialize(leaf_rows(docs), "merkle-leaves")
    order = [F.col("doc_id").asc_nulls_last(), F.col("leaf").asc(), F.col("nr").asc()]
    placed = materialize(ranked(leaves, order, "merkle-sorted").drop("nr"), "merkle-ranked")
    rounds = grow(placed.select("tree", "idx", "leaves", F.col("leaf").alias("digest")), "merkle-subtrees")
    roots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("digest"))
    tops = materialize(ranked(roots, [F.col("lang").asc()], "merkle-subroots"), "merkle-languages")
    return placed, rounds, [tops, *grow(tops.select("tree", "idx", "leaves", "digest"), "merkle-top")]


def folded(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    A leaf is H of doc_id, source, lang, n_chars and text.  Per language, leaves ascend by doc_id (rows without one come
    last, rows of one id by their leaf, equal rows count one by one); a missing language is a tree of its own, before all
    others.  ``folded_root`` starts from the tampered row where 3 divides the checksum of doc_id; a row without doc_id is
    not tampered with, a missing text stays missing, an empty one empty.  Texts are hashed whole, whatever their length.
    Other columns of ``docs`` play no part.  An empty table gives no rows.
    """
    placed, rounds, (tops, *above) = manifest(docs)
    top_paths = descend(above, above[-1].select("tree", F.col("block").alias("idx"), F.lit(b"").alias("path")), 0)
    whole = above[-1].select("tree", "root")
    subroots = tops.join(top_paths, ["tree", "idx"]).join(whole, "tree").select(
        F.col("lang").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"), "root"
    )
    paths = descend(rounds, subroots.select("tree", "idx", "path"), 1)
    ends = _with_paths(rounds[0].select("tree", "block", "body"), paths).join(subroots.select("tree", "subroot", "root"), "tree")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType

    def finish(key: tuple, rows: pa.Table, end: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        (got,) = end.to_pylist()
        tree = Subtree.unpack(got["body"])
        roots = to_bytes(along(got["path"], tree.fold(_stacked(rows.column("tampered"))))).hex()
        n, root = rows.num_rows, got["root"].hex()
        roots = [roots[64 * k : 64 * (k + 1)] for k in range(n)]
        return pa.table(
            [rows.column("doc_id").cast(to_arrow_type(id_type)), pa.array([x.hex() for x in rows.column("leaf").to_pylist()]),
             pa.array([got["subroot"].hex()] * n), pa.array([root] * n), pa.array(proofs(tree, siblings(got["path"]))),
             pa.array(roots), pa.array([x == root for x in roots])], names=names,
        )

    rows = in_subtrees(placed).select("tree", "block", "idx", "doc_id", "leaf", "tampered")
    return rows.groupBy("tree", "block").cogroup(ends.groupBy("tree", "block")).applyInArrow(
        finish, f"doc_id {id_type.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
