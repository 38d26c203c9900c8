"""Hard negatives against brute force, and walks that end early."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerloom.llm import negatives

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, every=100):
    clean = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        clean.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (a, label, v) in enumerate(clean):
        if a is None or a % every:
            continue
        scored = sorted((-dot(v, w), i is None, i or 0, m, i, other) for m, (i, other, w) in enumerate(clean) if m != k)
        near = [s for s in scored if s[5] == label][:5]
        for p in near:
            far = [s for s in scored if s[5] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:10]
            out += [(a, p[4], n, s[4], -p[0], -s[0]) for n, s in enumerate(far, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(6, 12))
    rows = []
    for i in range(900):
        v = centers[i % 6] + 0.7 * rng.normal(size=12)
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), i % 5))
    for i in range(900, 960):  # ties and repeated rows
        rows.append((i, rows[0][1], i % 3))
    rows += [rows[100], rows[100], (None, rows[100][1], 1), (None, rows[3][1], 0)]
    rows += [(1000, [0.0] * 12, 2), (1100, [], 2), (1200, [0.5] * 5, 3), (1300, None, 1), (1400, [0.1] * 12, None), (1500, [0.1] * 11 + [None], 1)]
    rows += [(1600, [0.1] * 11 + [float("nan")], 1), (1700, [float("inf")] + [0.1] * 11, 1), (1800, [300.0] * 12, 4), (1801, [-2e5] * 12, 4)]
    return rows


def got(df, **more):
    return sorted(map(tuple, negatives.hard_negatives(df, **more).collect()), key=repr)


@pytest.mark.parametrize("cells", [(8_192, 128 << 20, 64 << 20), (97, 4_000, 700)])
def test_brute_force(spark, vectors, monkeypatch, cells):
    for name, value in zip(("BLOCK_ROWS", "BLOCK_BYTES", "SLICE_BYTES"), cells, strict=True):
        monkeypatch.setattr(negatives, name, value)
    monkeypatch.setattr(negatives, "FIRST_STEP", 16)
    monkeypatch.setattr(negatives, "MATRIX_BYTES", 8 * 12 * 50)
    monkeypatch.setattr(negatives, "PER_CENTROID", 3)
    df = spark.createDataFrame(vectors, SCHEMA).selectExpr("*", "'x' AS row", "1 AS block", "2 AS scores").repartition(3)
    assert got(df) == brute(vectors)
    assert got(df, anchor_every=7) == brute(vectors, 7)


def test_empty(spark, vectors):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame(vectors[1:50], SCHEMA)) == []
    assert got(spark.createDataFrame([vectors[0]], SCHEMA)) == []


def test_walks_end_early_and_lose_nothing():
    rng = np.random.default_rng(4)
    centers = 300 * rng.normal(size=(20, 16))
    rows = np.rint(np.repeat(centers, 200, axis=0) + 10 * rng.normal(size=(4000, 16))).astype(np.int64)
    members, ids, none = rows[:4], np.arange(4000), np.empty(0, np.int64)
    bests = [negatives.Best(np.array([-(2**62)]), np.array([2**62]), 5, none, none) for _ in range(4)]
    visited = [0] * 4
    negatives.walk(members, bests, rows, ids, ids, np.arange(4), visited)
    for m, best in enumerate(bests):
        scores = rows @ members[m]
        order = [k for k in np.lexsort((ids, -scores)).tolist() if k != m][:5]
        assert best.row.tolist() == order and best.score.tolist() == scores[order].tolist()
    assert max(visited) < 4000


def test_large_components():
    big = np.array([[2**30, 3], [-(2**30), 5]])
    assert negatives.exact(big, 2.0**60).dtype == np.int64
    with pytest.raises(ValueError):
        negatives.exact(big, 2.0**62)
    with pytest.raises(ValueError):
        negatives.pack(np.array([2.0**62]))
    packed = [negatives.pack(np.array([1.0, -2.0])), negatives.pack(np.array([2.0**40])), negatives.pack(np.array([]))]
    assert negatives.matrix(packed, negatives.width_of(packed)).tolist() == [[1, -2], [2**40, 0], [0, 0]]
