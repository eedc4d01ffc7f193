"""Scratch output goes below the session's checkpoint folder."""

import subprocess
import sys

import pytest

from dqlens.session import scratch_path, shared_root


class _Context:
    def __init__(self, master, ckpt=None):
        self.master, self.ckpt = master, ckpt

    def getCheckpointDir(self):
        return self.ckpt


class _Session:
    def __init__(self, conf, master="spark://head:7077", ckpt=None):
        self.conf = conf
        self.sparkContext = _Context(master, ckpt)


def test_uses_the_configured_shared_folder():
    s = _Session({"spark.checkpoint.dir": "hdfs://nn/shared/ckpt/"})
    assert shared_root(s) == "hdfs://nn/shared/ckpt"
    assert scratch_path(s, "x").startswith("hdfs://nn/shared/ckpt/dqlens/x-")
    assert shared_root(_Session({}, ckpt="s3a://bucket/ckpt")) == "s3a://bucket/ckpt"


@pytest.mark.parametrize("master", ["spark://head:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(_Session({}, master))


REAL = """
from pyspark.sql import SparkSession
from dqlens.session import shared_root
b = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
spark = (b.config("spark.checkpoint.dir", {folder!r}) if {folder!r} else b).getOrCreate()
one = shared_root(spark)
assert one and one == shared_root(spark)
assert not {folder!r} or one == {folder!r}, one
print("fine")
"""


@pytest.mark.parametrize("named", [True, False])
def test_real_local_session(tmp_path, named):
    code = REAL.format(folder=str(tmp_path) if named else "")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120,
                         cwd=__file__.rsplit("/tests/", 1)[0])
    assert "fine" in out.stdout, out.stderr[-800:]
