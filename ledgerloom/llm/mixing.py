"""Mixing sources to target weights by pivotal dependent rounding.

A source is to give ``target`` words; a document's copies should average ``target / source_size``.  The whole part of that
is taken for every document.  The rest, a fraction, is rounded by pivots: of two documents with fractional copies, one
gains and the other loses the same number of words, by a random choice that keeps both expectations, until one of them
is whole.  Words are conserved at every step, so a source ends within one document of its target, and a document's
expected copies are exact.

Every row is rounded on its own: rows that agree in id, source, size and text are numbered among themselves, part by part of
a written table, so neither a repeated row nor a missing id gathers in one task.  Rows of a source are dealt to buckets by a
hash of id and number; each bucket reduces to one unfinished row, and these are reduced again in groups, level by level,
until one is left, whose fraction is decided by chance.  Chance is a hash of ids and numbers, so reruns agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import add_columns, long_field
from ledgerloom.sources.store import materialize

# Fixed values of the contract.
WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET_ROWS, FAN_IN = 1_000, 64
SPLIT = "at long, doc_id long, nr long, source_no long, bucket long, size long, part double, up long, open boolean"


def _sizes(batch: pa.RecordBatch) -> list[list[int]]:
    return [[len((x.as_py() or "").encode().split()) for x in batch.column("text")]]


def sized(docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    """``keep`` columns, ``size``, a hash ``like`` of what makes rows alike, and the row number ``at``, as a written table."""
    rows = add_columns(docs.withColumn("like", F.xxhash64("text")), [long_field("size")], _sizes, [*keep, "like"])
    return materialize(rows.withColumn("at", F.monotonically_increasing_id()), name)


def numbered(rows: DataFrame) -> DataFrame:
    """(at, doc_id, source, size, nr): ``nr`` tells rows with one id apart, the same way in every run.

    Alike rows are counted per part of the written table, so a row that makes up much of the table is numbered in as many
    tasks as it has parts; which of them gets which number does not matter.
    """
    alike = ["doc_id", "source", "size", "like"]
    parts = rows.withColumn("piece", F.shiftright("at", 33))
    inside = Window.partitionBy(*alike, "piece").orderBy("at")
    counts = parts.groupBy(*alike, "piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*alike).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias(f"_{c}") for c in (*alike, "piece")], F.sum("n").over(earlier).alias("before")).where("before > 0")
    same = F.lit(True)
    for c in (*alike, "piece"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return parts.withColumn("inside", F.row_number().over(inside)).join(before, same, "left").select(
        "at", "doc_id", "source", "size", F.xxhash64("source", "size", "like", F.col("inside") + F.coalesce("before", F.lit(0))).alias("nr")
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source_no, source, source_size, docs, target) from (source, size): one row for each source.

    The level ``x`` at which weights and caps use up all words solves ``sum(min(3 s, x w)) = sum(s)``: with sources
    in the order of their saturation ``3 s / w``, those below the level take their cap, the others share the rest.
    Runs over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    named = per.withColumn("source_no", place.cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    capped = named.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size").cast("double"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    stepped = capped.select(
        "*",
        F.sum(F.col("source_size").cast("double")).over(whole).alias("_all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("_caps"),
        F.sum("weight").over(whole).alias("_weights"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("_gone"),
    )
    level = (F.col("_all") - F.col("_caps")) / (F.col("_weights") - F.col("_gone"))
    # The first source, in that order, that stays under its cap sets the level for itself and all after it.
    first = F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("k"), "source_no", level.alias("x")))).over(whole)
    after = F.struct((F.col("cap") / F.col("weight")).alias("k"), "source_no") >= F.struct(first["k"], first["source_no"])
    target = F.when(after, first["x"] * F.col("weight")).otherwise(F.col("cap"))
    return stepped.select("source_no", "source", "source_size", "docs", target.alias("target"))


def chance(*parts) -> float:
    """A number in [0, 1) that depends on the parts only."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivot(rows: list[tuple[int | None, int, int, float]], salt: int) -> tuple[list[int], tuple[int, float] | None]:
    """Rounds (doc_id, nr, size, part) with 0 < part < 1: a whole part for each row, and the place and part of one unfinished."""
    done = [0] * len(rows)
    held: tuple[int, float] | None = None
    for place, (b, bn, t, q) in enumerate(rows):
        if held is None:
            held = place, q
            continue
        other, p = held
        a, an, s, _ = rows[other]
        # Words that can go from b to a, and from a to b.
        gain, loss = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        if chance(salt, a, an, b, bn) * (gain + loss) < loss:
            a_whole = (1 - p) * s <= q * t
            p, q = (1.0, q - gain / t) if a_whole else (p + gain / s, 0.0)
        else:
            a_whole = p * s <= (1 - q) * t
            p, q = (0.0, q + loss / t) if a_whole else (p - loss / s, 1.0)
        done[other if a_whole else place] = int(p if a_whole else q)
        held = (place, q) if a_whole else (other, p)
        if not 1e-12 < held[1] < 1 - 1e-12:
            done[held[0]] = round(held[1])
            held = None
    return done, held


def _reduce(key: tuple, group: pa.Table) -> pa.Table:
    """One bucket: all its rows come out, one of them unfinished at most.  Largest first, so small ones remain."""
    names = ("doc_id", "nr", "size", "part", "at")
    listed = zip(*(group.column(c).to_pylist() for c in names), strict=True)
    rows = sorted(listed, key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1]))
    done, held = pivot([r[:4] for r in rows], key[0].as_py())
    n, (place, part) = len(rows), held or (-1, 0.0)
    return pa.table(
        {
            "at": pa.array([r[4] for r in rows], pa.int64()),
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "nr": pa.array([r[1] for r in rows], pa.int64()),
            "source_no": pa.array([key[0].as_py()] * n, pa.int64()),
            "bucket": pa.array([key[1].as_py()] * n, pa.int64()),
            "size": pa.array([r[2] for r in rows], pa.int64()),
            "part": pa.array([part if k == place else 0.0 for k in range(n)], pa.float64()),
            "up": pa.array(done, pa.int64()),
            "open": pa.array([k == place for k in range(n)], pa.bool_()),
        }
    )


def _last_chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            r["up"], r["open"] = int(chance("last", r["source_no"], r["doc_id"], r["nr"]) < r["part"]), False
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def taken_copies(rows: DataFrame) -> DataFrame:
    """(at, doc_id, size, source_size, target, copies) for every row of a table that ``sized`` wrote.

    Documents without words are taken as often as their source's share says, rounded down: they carry no words either way.
    """
    targets = materialize(source_targets(rows), "mix-targets")
    per_row = numbered(rows).join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "at", "doc_id", "nr", "source_no", "size", "source_size", "target", "docs",
        F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)).alias("_rate"),
    )
    ready = per_row.select(
        "*", F.floor("_rate").cast("long").alias("whole"), (F.col("_rate") - F.floor("_rate")).alias("part"),
        F.pmod(F.xxhash64("doc_id", "nr"), F.ceil(F.col("docs") / BUCKET_ROWS).cast("long")).alias("bucket"),
    )
    ready = materialize(ready.drop("_rate", "docs"), "mix-ready")
    most = targets.agg(F.max("docs")).first()[0] or 0
    part = F.col("part")
    fractional = (F.col("size") > 0) & (part > 1e-12) & (part < 1 - 1e-12)
    level = ready.where(fractional).select("at", "doc_id", "nr", "source_no", "bucket", "size", "part")
    buckets, finished = math.ceil(most / BUCKET_ROWS), []
    while True:
        reduced = materialize(level.groupBy("source_no", "bucket").applyInArrow(_reduce, SPLIT), "mix-level")
        finished.append(reduced.where("NOT open"))
        rest = reduced.where("open")
        if buckets <= 1:
            break
        buckets = math.ceil(buckets / FAN_IN)
        level = rest.select(
            "at", "doc_id", "nr", "source_no", F.floor(F.col("bucket") / FAN_IN).cast("long").alias("bucket"), "size", "part"
        )
    finished.append(rest.mapInArrow(_last_chance, rest.schema))
    ups = finished[0]
    for more in finished[1:]:
        ups = ups.unionByName(more)
    near = F.when((F.col("size") > 0) & (part >= 1 - 1e-12), F.lit(1)).otherwise(F.lit(0))
    return ready.join(ups.select("at", "up"), "at", "left").select(
        "at", "doc_id", "size", "source_size", "target", (F.col("whole") + F.coalesce("up", near)).cast("long").alias("copies"),
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of ``docs``.

    A missing or empty text has no words; a missing source is a source of its own, after all others.  Rows that repeat an
    id, or all of another row, or have no id, are rounded one by one.  Texts of any length count whole.  Other columns
    play no part; an empty table gives no rows.
    """
    rows = sized(docs.select("doc_id", "source", "text"), ["doc_id", "source"], "mix-sizes")
    return taken_copies(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` the mix takes, with ``copies``, ``taken``, ``target`` and ``source_size`` beside their own columns.

    Own columns of these names, and of the names used on the way, are replaced or kept apart.  See ``mix_report`` for odd rows.
    """
    new = ["copies", "taken", "target", "source_size"]
    own = docs.drop(*new)
    apart = {c: f"_own_{c}" for c in own.columns if c in ("at", "like", "size")}
    renamed = own.withColumnsRenamed(apart)
    rows = sized(renamed, renamed.columns, "mix-rows")
    got = taken_copies(rows.select("at", "doc_id", "source", "size", "like")).where("copies > 0").select(
        "at", "copies", "target", "source_size", (F.col("copies") * F.col("size")).alias("taken")
    )
    return rows.drop("size", "like").join(got, "at").drop("at").withColumnsRenamed({v: k for k, v in apart.items()}).select(*own.columns, *new)
