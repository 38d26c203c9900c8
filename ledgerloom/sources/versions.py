"""Tables that change as a whole: data folders that are only ever added, and a small manifest that names the current ones.

A write puts its rows into folders of its own and then makes them current by renaming one manifest file to the next number.
Until then, and after any failure before it, readers see the version before.  The manifest also keeps the last batch of
every writer, so a replayed micro-batch changes nothing.  Two writers that start from one version cannot both rename: the
second one fails and may try again.

A table is cut into parts by a text column (a month, a bucket of accounts); a write replaces whole parts and leaves the
others' folders as they are.  The manifest holds a line per part, so its size is that of the calendar, not of the data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "part"


class Conflict(RuntimeError):
    """Another writer has made a version since the one this write started from."""


@dataclass(frozen=True)
class Version:
    """What a table consists of: folder by part, the last batch by writer, and other whole numbers writers keep (``marks``)."""

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("manifests").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> Version:
        files, folder = self._files(), self._path("manifests")
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        numbers = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        if not numbers:
            return Version()
        text = self.spark.read.text(f"{self.path}/manifests/{numbers[-1]:012d}.json", wholetext=True).first()[0]
        got = json.loads(text)
        return Version(numbers[-1], got["parts"], got["batches"], got["marks"])

    def read(self, version: Version | None = None, parts: list[str] | None = None) -> DataFrame:
        """Rows of a version (default the current one), of some parts only if ``parts`` names them."""
        version = version or self.current()
        folders = [f"{self.path}/{x}" for p, x in sorted(version.parts.items()) if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(
        self, rows: DataFrame, part, replaced: list[str], since: Version, batch: tuple[str, int] | None = None, marks: dict[str, int] | None = None
    ) -> Version:
        """Makes ``rows``, cut by the column ``part``, the contents of the parts ``replaced`` (those without rows become empty).

        Tasks are as many as the rows need: Spark splits large parts and packs small ones.
        """
        folder = f"data/{uuid.uuid4().hex}"
        cut = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], part.cast("string").alias(PART))
        cut.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        files = self._files()
        made = {x.getPath().getName() for x in files.listStatus(self._path(folder)) if x.isDirectory()}
        new = {p: f"{folder}/{PART}={p}" for p in replaced if f"{PART}={p}" in made}
        if extra := made - {f"{PART}={p}" for p in replaced}:
            raise ValueError(f"rows outside the parts to be replaced: {sorted(extra)[:5]}")
        kept = {p: x for p, x in since.parts.items() if p not in replaced}
        batches = since.batches | ({batch[0]: batch[1]} if batch else {})
        return self._commit(Version(since.number + 1, kept | new, batches, since.marks | (marks or {})))

    def _commit(self, version: Version) -> Version:
        jvm, files = self.spark._jvm, self._files()
        temporary, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{version.number:012d}.json")
        stream = files.create(temporary, False)
        stream.write(json.dumps({"parts": version.parts, "batches": version.batches, "marks": version.marks}, sort_keys=True).encode())
        stream.close()
        option = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = getattr(option, "NONE")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(temporary), context.makeQualified(final), options)
        except Py4JJavaError as error:
            files.delete(temporary, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {version.number} of {self.path} exists") from None
            raise
        return version

    def update(
        self, incoming: DataFrame, part, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None, tries: int = 3
    ) -> Version:
        """Replaces the parts that occur in ``incoming`` by ``merge(their rows, incoming)``.

        A ``batch`` (writer, number) that the table already holds changes nothing.  After a conflict the merge is done again
        on the newer version.
        """
        touched = sorted(r[0] for r in incoming.select(part.cast("string")).distinct().collect())
        for left in reversed(range(tries)):
            since = self.current()
            if batch and since.batches.get(batch[0], -1) >= batch[1]:
                return since
            try:
                return self.write(merge(self.read(since, touched), incoming), part, touched, since, batch)
            except Conflict:
                if not left:
                    raise
        return since
