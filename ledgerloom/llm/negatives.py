"""Hard-negative mining from embeddings, with lists shared by clusters of anchors.

Components become whole numbers, so inner products are exact.  Anchors of one label that point the same way form a cluster.  By
the triangle inequality for angles, no member's inner product with a candidate exceeds
``|anchor| |candidate| cos(max(0, angle(candidate, centroid) - radius))``.  For each cluster the candidates of a block are sorted by
that bound once; every member walks the list, computing exact scores, until the next bound cannot reach what it still wants.

Rows are dealt to blocks by hash, anchors to slices; a task holds one block and one slice, and returns a bounded best list for
each anchor.  The first pass finds the positives (same label), the second the negatives in the score bands that the
positives set (other labels).  Bounds only end walks early; results are exact.

Centroids that name the clusters are fitted on at most ``SAMPLE`` anchors.  Nothing else is sampled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import NO_ID
from ledgerloom.sources.store import materialize

# Fixed values of the contract.
SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES, LOW_PERCENT, HIGH_PERCENT = 256.0, 100, 5, 10, 30, 90

SAMPLE, CENTROIDS, PER_CENTROID = 2_048, 64, 64
BLOCK_BYTES, SLICE_BYTES, BLOCK_ROWS = 128 << 20, 64 << 20, 8_192
MATRIX_BYTES, FIRST_STEP = 64 << 20, 1_024
PACKED = "vec_id long, label long, vector binary"


# ---- vectors -----------------------------------------------------------------------------------------------------


def pack(row: np.ndarray) -> bytes:
    """Whole numbers, two bytes each where they fit, else eight; the first byte says which."""
    if not len(row) or np.abs(row).max() < 1 << 15:
        return b"\x02" + row.astype("<i2").tobytes()
    if np.abs(row).max() >= 2.0**62:
        raise ValueError("a component of 2**62 or more has no exact inner product in a long")
    return b"\x08" + row.astype("<i8").tobytes()


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Rows of whole numbers; missing components at the end count as 0."""
    if all(v[0] == 2 and len(v) == 2 * width + 1 for v in vectors):
        return np.frombuffer(b"".join(v[1:] for v in vectors), "<i2").reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        row = np.frombuffer(v, f"<i{v[0]}", offset=1)
        out[k, : len(row)] = row
    return out


def width_of(vectors: list[bytes]) -> int:
    return max(((len(v) - 1) // v[0] for v in vectors), default=0)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part: a label, and a vector of finite components only."""

    def step(batches):
        for batch in batches:
            ids, labels, column = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            starts, sizes = column.offsets.to_numpy(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = np.floor(SCALE * column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            out: tuple[list, list, list] = ([], [], [])
            for k, (i, label) in enumerate(zip(ids, labels, strict=True)):
                row = values[starts[k] : starts[k] + sizes[k]]
                if label is None or not column[k].is_valid or not np.isfinite(row).all():
                    continue
                out[0].append(i)
                out[1].append((label + 1) % 10 if i is not None and i % 7 == 0 else label)
                out[2].append(pack(row))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["vec_id", "label", "vector"])

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col(vector).cast("array<double>")).mapInArrow(step, PACKED)


def directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero rows stay zero) and lengths."""
    rows = rows.astype(np.float64)
    length = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(length > 0, length, 1)[:, None], length


def fitted_centroids(units: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced seeds."""
    if not len(units):
        return units
    centers = units[np.linspace(0, len(units) - 1, min(k, len(units))).astype(int)]
    for _ in range(rounds):
        nearest = (units @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, units)
        centers = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, directions(sums)[0], centers)
    return centers


# ---- walks -------------------------------------------------------------------------------------------------------


@dataclass
class Best:
    """What one anchor wants: the ``count`` best scores in each band [low, high], smaller ids first among equals."""

    low: np.ndarray
    high: np.ndarray
    count: int
    score: np.ndarray
    row: np.ndarray

    def floor(self) -> float:
        """A score below this changes nothing any more."""
        out = np.inf
        for low, high in zip(self.low, self.high, strict=True):
            at = np.searchsorted(-self.score, -high)
            last = at + self.count - 1
            out = min(out, max(self.score[last], low) if last < len(self.score) else low)
        return out

    def add(self, score: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        keep = (score >= self.floor()) & (score <= self.high.max())
        score, row = np.append(self.score, score[keep]), np.append(self.row, row[keep])
        order = np.lexsort((ids[row], -score))
        score, row = score[order], row[order]
        wanted = np.zeros(len(score), bool)
        for low, high in zip(self.low, self.high, strict=True):
            at = np.searchsorted(-score, -high)
            wanted[at : at + self.count] |= score[at : at + self.count] >= low
        self.score, self.row = score[wanted], row[wanted]

    def bands(self) -> list[tuple[int, int, int]]:
        """(band, place in the band, place in ``row``) of all that is wanted."""
        out = []
        for band, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            at = int(np.searchsorted(-self.score, -high))
            out += [(band, n, k) for n, k in enumerate(range(at, min(at + self.count, len(self.score)))) if self.score[k] >= low]
        return out


def exact(rows: np.ndarray, most: float) -> np.ndarray:
    """In the narrowest type in which inner products up to ``most`` (by lengths) are exact."""
    if most < 1 << 24:
        return rows.astype(np.float32)
    if most < 1 << 53:
        return rows.astype(np.float64)
    if most < 2.0**62:
        return rows.astype(np.int64)
    raise ValueError("inner products beyond a long")


def walk(members: np.ndarray, bests: list[Best], candidates: np.ndarray, places: np.ndarray, ids: np.ndarray, skip: np.ndarray, visited: list | None = None) -> None:
    """Lets every member of a cluster walk the shared list of ``candidates`` (rows ``places`` of the block with ``ids``).

    ``skip`` names for each member a place that is the member itself, or -1.  ``visited`` collects how far each walk went.
    """
    own, own_length = directions(members)
    units, length = directions(candidates)
    center = directions(own.sum(axis=0, keepdims=True))[0][0]
    radius = np.arccos(np.clip(own @ center, -1, 1)).max()
    # Slack covers rounding; a bound that is too high only makes a walk longer.
    angle = np.arccos(np.clip(units @ center, -1, 1)) - radius - 1e-6
    bound = length * np.cos(np.maximum(angle, 0.0))
    order = np.argsort(-bound, kind="stable")
    bound = bound[order] * (1 + 1e-9) + 1e-6
    most = float(own_length.max() * length.max()) if len(length) else 0.0
    left, right = exact(members, most), exact(candidates[order], most)
    at, step, active = 0, FIRST_STEP, list(range(len(members)))
    while at < len(order):
        active = [m for m in active if bound[at] * own_length[m] + 1e-6 >= bests[m].floor()]
        if not active:
            break
        upto = min(at + step, len(order))
        scores = (left[active] @ right[at:upto].T).astype(np.int64)
        here = places[order[at:upto]]
        for m, score in zip(active, scores, strict=True):
            if skip[m] >= 0 and (here == skip[m]).any():
                bests[m].add(score[here != skip[m]], here[here != skip[m]], ids)
            else:
                bests[m].add(score, here, ids)
            if visited is not None:
                visited[m] = upto
        at, step = upto, 2 * step


def clusters_of(labels: np.ndarray, units: np.ndarray, centers: np.ndarray) -> list[np.ndarray]:
    nearest = (units @ centers.T).argmax(axis=1) if len(centers) else np.zeros(len(units), int)
    order = np.lexsort((nearest, labels))
    edge = np.flatnonzero((np.diff(labels[order]) != 0) | (np.diff(nearest[order]) != 0)) + 1
    return np.split(order, edge)


# ---- jobs --------------------------------------------------------------------------------------------------------


FOUND = "anchor long, best array<struct<band: int, less: long, missing: boolean, vec_id: long>>"
_FOUND = pa.list_(pa.struct([("band", pa.int32()), ("less", pa.int64()), ("missing", pa.bool_()), ("vec_id", pa.int64())]))
ANY = (-(2**62), 2**62)


def search(same: bool, centers: np.ndarray, low_percent: int, high_percent: int, count: int):
    """The step over one block of rows and one slice of anchors.

    Anchors come with the scores of their positives; each sets a band of negatives, while for positives the band is open.
    """

    def step(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], _FOUND)], names=["anchor", "best"])
        packed, asked = rows.column("vector").to_pylist(), anchors.column("vector").to_pylist()
        width = max(width_of(packed), width_of(asked), centers.shape[1] if len(centers) else 0)
        number, labels = (rows.column(c).to_numpy() for c in ("row", "label"))
        ids = rows.column("vec_id").fill_null(NO_ID).to_numpy()
        members, wanted = matrix(asked, width), anchors.column("label").to_numpy()
        own = anchors.column("row").to_numpy()
        bests = []
        for scores in anchors.column("scores").to_pylist():
            # low <= 100 s <= high in whole numbers, so the limits round inwards.
            limits = [ANY] if same else [(-(-low_percent * p // 100), high_percent * p // 100) for p in scores]
            low, high = (np.array([x[k] for x in limits], np.int64) for k in (0, 1))
            fits = low <= high
            bests.append(Best(low[fits], high[fits], count, np.empty(0, np.int64), np.empty(0, np.int64)))
        bands = [None if same else [k for k, p in enumerate(s) if -(-low_percent * p // 100) <= high_percent * p // 100] for s in anchors.column("scores").to_pylist()]
        groups = clusters_of(wanted, directions(members)[0], np.pad(centers, ((0, 0), (0, width - centers.shape[1]))) if len(centers) else centers)
        place = {n: k for k, n in enumerate(number.tolist())}
        skip = np.array([place.get(n, -1) for n in own.tolist()])
        cut = max(1, MATRIX_BYTES // (8 * max(width, 1)))
        for a in range(0, len(packed), cut):
            part, these = matrix(packed[a : a + cut], width), labels[a : a + cut]
            for group in groups:
                group = group[[len(bests[m].low) > 0 for m in group]]
                if not len(group):
                    continue
                fits = np.flatnonzero((these == wanted[group[0]]) == same)
                if len(fits):
                    walk(members[group], [bests[m] for m in group], part[fits], fits + a, ids, skip[group])
        found = []
        for best, kept in zip(bests, bands, strict=True):
            found.append([
                {"band": 0 if kept is None else kept[band], "less": -int(best.score[k]), "missing": bool(ids[best.row[k]] == NO_ID), "vec_id": None if ids[best.row[k]] == NO_ID else int(ids[best.row[k]])}
                for band, _, k in best.bands()
            ])
        return pa.table([pa.array(own), pa.array(found, _FOUND)], names=["anchor", "best"])

    return step


def _best(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first ``count`` entries of each key, merged over the blocks: (keys, merged)."""
    entry = F.col("entry")
    listed = found.select("anchor", F.explode("best").alias("entry")).select("anchor", entry["band"].alias("band"), F.struct(entry["less"].alias("less"), entry["missing"].alias("missing"), entry["vec_id"].alias("vec_id")).alias("e"))
    return listed.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("e")), 1, count).alias("merged"))


def hard_negatives(
    rows: DataFrame, vector: str = "embedding", anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT, centroids: int = CENTROIDS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows without a label, without a vector, or with a missing or non-finite component take no part.  Anchors are the rows whose
    ``vec_id`` divides by ``anchor_every``; a row without vec_id is no anchor, and comes last among equal scores.  Rows that
    repeat a vec_id count one by one; an anchor is never its own positive.  Vectors of different widths are filled up with
    zeros, an empty vector is all zeros.  Other columns play no part; an empty table, or one without anchors, gives no rows.
    Components whose inner products do not fit a long raise an error.
    """
    spark = rows.sparkSession
    stored = materialize(usable(rows, vector).withColumn("row", F.monotonically_increasing_id()), "negative-vectors")
    is_anchor = F.col("vec_id") % anchor_every == 0
    anchors = materialize(stored.where(is_anchor).withColumn("scores", F.array().cast("array<long>")), "negative-anchors")
    size = F.octet_length("vector")
    got = stored.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b"), F.count_if(is_anchor).alias("anchors"),
        F.coalesce(F.sum(F.when(is_anchor, size)), F.lit(0)).alias("anchor_b"),
    ).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(got.b / BLOCK_BYTES), min(tasks, math.ceil(got.n / BLOCK_ROWS)), 1)
    slices = max(math.ceil(got.anchor_b / SLICE_BYTES), 1)
    sample = anchors.select("vector").orderBy(F.xxhash64("row")).limit(SAMPLE).collect()
    listed = [bytes(r.vector) for r in sample]
    k = min(centroids, math.ceil(got.anchors / PER_CENTROID))
    centers = fitted_centroids(directions(matrix(listed, width_of(listed)))[0], k) if listed else np.empty((0, 0))

    def cells(df: DataFrame, own: str, other: str, n: int, most: int):
        copies = df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
        return copies.groupBy("block", "slice")

    def found(asking: DataFrame, same: bool, count: int) -> DataFrame:
        held = cells(stored.select("row", "vec_id", "label", "vector"), "block", "slice", blocks, slices)
        asked = cells(asking.select("row", "label", "vector", "scores"), "slice", "block", slices, blocks)
        return held.cogroup(asked).applyInArrow(search(same, centers, low_percent, high_percent, count), FOUND)

    near = _best(found(anchors, True, positives), ["anchor"], positives)
    chosen = near.select(F.col("anchor").alias("row"), "merged", F.transform("merged", lambda e: -e["less"]).alias("scores"))
    asking = materialize(anchors.drop("scores").join(chosen, "row"), "negative-positives")
    far = _best(found(asking, False, negatives), ["anchor", "band"], negatives)
    positive = F.element_at("merged_positive", F.col("band") + 1)
    return (
        far.join(asking.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("merged").alias("merged_positive")), "anchor")
        .select("anchor_id", positive.alias("p"), F.posexplode("merged").alias("n", "e"))
        .select(
            "anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("n") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("negative_id"),
            (-F.col("p.less")).alias("positive_score"), (-F.col("e.less")).alias("negative_score"),
        )
    )
