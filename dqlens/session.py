"""Session helpers.

The library never creates or stops a session on its own: every operator takes
the caller's ``SparkSession`` (or a DataFrame bound to one).  ``get_spark`` is
only a convenience for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "dqlens") -> SparkSession:
    """Build (or reuse) a session with the settings the profiler relies on.

    AQE stays on so shuffle partitions are coalesced at runtime and small join
    sides are broadcast only after their materialised size is known.
    """
    master = master or os.environ.get("DQLENS_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DQLENS_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is the only place scratch output may go (every executor
    and the driver see it); a cluster session without the setting is an
    error.  Only a local session, as in tests, may go without: it has one
    machine, so its context gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dqlens-ckpt-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared root for one run's output."""
    return f"{shared_root(spark)}/dqlens/{name}-{uuid.uuid4().hex[:12]}"


_CONF_LOCK = threading.RLock()


@contextmanager
def session_conf(spark: SparkSession, key: str, value: str):
    """Set a SQL conf for the duration of a block, then restore it.  One block
    at a time: threads that changed the same setting in turns could otherwise
    restore each other's value."""
    with _CONF_LOCK:
        old = spark.conf.get(key, None)
        spark.conf.set(key, value)
        try:
            yield
        finally:
            if old is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, old)
