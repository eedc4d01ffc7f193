"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import dqlens
from dqlens.session import scratch_path, session_conf

#: a word: a run of characters other than space and the ASCII control spaces
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

# glibc has it; elsewhere freed memory is the allocator's business
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _TRIM = None

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (a null id gives null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def ship_code(spark: SparkSession) -> None:
    """Hand this package to the executors as a zip (``addPyFile``), once per
    context, so that Python tasks can import it wherever the driver was
    started.  Nothing to do where the package already is a shipped zip."""
    sc, root = spark.sparkContext, Path(dqlens.__file__).parent
    if getattr(sc, "_dqlens_code", None) or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="dqlens-code-")) / "dqlens_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("dqlens") / f.relative_to(root))
    sc.addPyFile(str(path))
    sc._dqlens_code = str(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends
    here, and a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._dqlens_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._dqlens_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: rows of a few numbers that may be broadcast: some tens of MB
BROADCAST_ROWS = 500_000


def sized(narrow: DataFrame) -> DataFrame:
    """A stored table of ids with the join that its counted size allows: a
    broadcast up to ``BROADCAST_ROWS``, beyond that a shuffled hash join."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow.hint("shuffle_hash")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Spark's own limit is 64 MB: a task's texts then reach Python as one batch
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within the block rows go to Python about 2 MB at a time, however long they
    are.  What leaves it must be written down: a plan that runs later has the
    caller's limit."""
    with session_conf(spark, *BATCH_BYTES):
        yield


def give_back() -> None:
    """Hand memory that this Python worker has freed back to the system.  Spark
    keeps workers for the next task; what allocators hold for reuse would count
    against the executor for as long."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_KEPT: dict = {}


def kept(key: str, make: Callable):
    """What ``make`` returns, made once per Python worker and kept until another
    key is asked for or a task that does not keep it begins (``let_go``)."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go(but: str | None = None) -> None:
    """Drop what tasks of another kind have left in this Python worker."""
    for key in [k for k in _KEPT if k != but]:
        del _KEPT[key]


def tidy(run: Callable, keeps: str | None = None) -> Callable:
    """``run`` (batches -> batches, for ``mapInArrow`` and ``mapInPandas``) in a worker that
    has ``kept`` nothing but ``keeps``, followed by ``give_back``."""
    def tidied(batches):
        let_go(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()
    return tidied


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added while the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --------------------------------------------------------------------------
# numpy helpers used inside tasks
# --------------------------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordIds(dict):
    """Word -> dense id in order of first sight, for one batch or task."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n
