"""Session builder and the shared folder used for cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

_TO_DELETE: set[str] = set()


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator is written against.

    ANSI stays on (the 4.x default): operators guard their own divisions.  AQE splits skewed joins, picks
    broadcasts from measured sizes and coalesces small shuffle partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _delete(files, path) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone already
        files.delete(path, True)


def checkpoint_folder(spark: SparkSession) -> str:
    """This session's own folder below the one the cluster names in ``spark.checkpoint.dir``.

    Without that setting a scratch folder serves a local master; on a cluster the executors would not see it, so the
    call fails instead.  The folder goes when the program ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(named)
    folder = f"{named.rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}"
    if folder not in _TO_DELETE:
        _TO_DELETE.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        atexit.register(_delete, path.getFileSystem(spark._jsc.hadoopConfiguration()), path)
    return folder
