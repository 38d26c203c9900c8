"""The Merkle manifest against plain hashing, its vectorised SHA-256, and folding by midstates."""

import hashlib
import zlib

import numpy as np
import pytest

from ledgerloom.llm import merkle

H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes):
    """All levels from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def climb(tree, place, now):
    others = []
    for level in tree[:-1]:
        low = place - place % 8
        run = level[low : low + 8]
        others += run[: place - low] + run[place - low + 1 :]
        now = H(run[: place - low] + [now] + run[place - low + 1 :])
        place //= 8
    return now, others


def brute(rows):
    trees = {}
    for i, text, lang, source in rows:
        leaf = lambda t: H([field(i), field(source), field(lang), field(None if text is None else len(text)), field(t)])  # noqa: E731,B023
        low = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        trees.setdefault(lang, []).append((i is None, i or 0, leaf(text), leaf(low) if hit else leaf(text), i))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels([r[2] for r in sorted(trees[x], key=lambda r: r[:3])]) for x in langs}
    top = levels([built[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for place, (_, _, leaf, tampered, i) in enumerate(sorted(trees[x], key=lambda r: r[:3])):
            now, others = climb(built[x], place, tampered)
            now, more = climb(top, k, now)
            out.append((i, leaf, built[x][-1][0], top[-1][0], H(others + more), now, now == top[-1][0]))
    return sorted(out, key=repr)


def got(docs):
    return sorted(map(tuple, merkle.folded(docs).collect()), key=repr)


def test_sha256_of_many():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 1 << 32, (8, 5000), dtype=np.uint32)
    one = merkle.closed(merkle.compress(merkle.first_states(5000), merkle.as_block(raw)), np.ones(5000, int))
    hexed, made = merkle.to_bytes(raw).hex(), merkle.to_bytes(one).hex()
    for k in (0, 1, 4096, 4999):
        assert made[64 * k : 64 * k + 64] == hashlib.sha256(hexed[64 * k : 64 * k + 64].encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 100])
def test_subtree_folds_and_paths(n):
    leaves = [H([str(k)]) for k in range(n)]
    tree = merkle.Subtree.unpack(merkle.Subtree.build(merkle.from_bytes(bytes.fromhex("".join(leaves))), merkle.levels_of(n)).pack())
    plain = levels(leaves)
    assert merkle.to_bytes(tree.digests[-1]).hex() == plain[-1][0]
    fresh = [H(["new", str(k)]) for k in range(n)]
    roots = merkle.to_bytes(tree.fold(merkle.from_bytes(bytes.fromhex("".join(fresh))))).hex()
    for k in range(n):
        want, others = climb(plain, k, fresh[k])
        assert roots[64 * k : 64 * k + 64] == want
        one = merkle.from_bytes(bytes.fromhex(fresh[k]))
        assert merkle.to_bytes(merkle.along(tree.path(k), one)).hex() == want
        assert merkle.siblings(tree.path(k)).decode() == "".join(others)


@pytest.mark.parametrize("height", [1, 4])
def test_manifest_is_plain_hashing(make_docs, sample_rows, odd_rows, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = sample_rows + odd_rows + [(9000 + k, f"Text {k}", f"l{k % 11}", None) for k in range(60)] + [(9100, "Same", "en", "s")] * 30
    assert got(make_docs(rows, clashing=True).repartition(7)) == brute(rows)


def test_small_and_empty(make_docs):
    assert got(make_docs([])) == []
    assert got(make_docs([(1, None, None, None)])) == brute([(1, None, None, None)])
    many = [(k, "x" * 100_000 + "Y", None, "a") for k in range(9)]
    assert got(make_docs(many)) == brute(many)
    assert not all(r[-1] for r in brute(many))
