"""The shared folder: required on a cluster, gone after a local run."""

import subprocess
import sys
import textwrap

import pytest

from ledgerloom import session


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(Session())


def test_a_run_leaves_no_tables(tmp_path):
    code = f"""
        from ledgerloom.session import build_session
        from ledgerloom.sources.store import materialize
        spark = build_session("leaves", "local[1]", **{{"spark.checkpoint.dir": {str(tmp_path)!r}, "spark.ui.enabled": "false"}})
        assert materialize(spark.range(3), "three").count() == 3
        spark.stop()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, timeout=120, capture_output=True)
    assert not [p for p in tmp_path.rglob("*.parquet")]
