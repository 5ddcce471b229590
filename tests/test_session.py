"""build_session and checkpoint_dir leave a configured cluster's settings alone."""

import os
import subprocess
import sys

import pytest

from chronoframe.config import build_session, checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_active_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    again = build_session(app_name="other")
    assert again.sparkContext is spark.sparkContext
    assert again.sparkContext.master == "local[4]" and again.conf.get("spark.sql.shuffle.partitions") == before


def test_preset_master_and_partitions_survive():
    code = (
        "from chronoframe.config import build_session; s = build_session(); "
        "print('GOT', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), "
        "s.sparkContext.getConf().get('spark.driver.memory', 'unset'))"
    )
    args = "--master local[1] --conf spark.sql.shuffle.partitions=17 --conf spark.ui.enabled=false pyspark-shell"
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": args}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "GOT local[1] 17 unset" in out.stdout, out.stderr[-2000:]


def test_no_local_scratch_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
