"""Landing, report and catalogue tables on shared storage.

Layout below one base folder (any Hadoop path: HDFS, object store, local):

    <base>/landing/user_id=<u>/dataset_id=<d>/part-*.parquet   raw lines
    <base>/reports/user_id=<u>/dataset_id=<d>/part-*.parquet   one report row
    <base>/columns/user_id=<u>/dataset_id=<d>/part-*.parquet   long-form profile
    <base>/catalog_events/user_id=<u>/part-*.parquet           status events
    <base>/claims/<hh>/<hash of the id>                        owner of an id
    <base>/states/user_id=<u>/dataset_id=<d>/increment=<n>/    value states of a growing dataset

Folder names are escaped with Spark's own rules, so any id is one path
component.  Writes of one dataset replace its folder, so re-running a job for
the same dataset does not duplicate it, and Spark's commit protocol makes a
retried task (lost executor) invisible.  Reads of one dataset address its
folder directly: no listing of the whole table.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_EVENT_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
    T.StructField("status", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("custom_name", T.StringType(), True),
    T.StructField("filename", T.StringType(), True),
    T.StructField("step", T.StringType(), True),
    T.StructField("row_count", T.LongType(), True),
    T.StructField("column_count", T.LongType(), True),
    T.StructField("hdfs_path", T.StringType(), True),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("deleted_at", T.TimestampNTZType(), True),
    T.StructField("seq", T.LongType(), True),
    T.StructField("user_id", T.StringType(), False),
])

LANDED_SCHEMA = "file string, file_size bigint, block bigint, seq bigint, line string"


def checked_id(value) -> str:
    """An id as text; empty ids have no folder of their own."""
    text = str(value)
    if not text:
        raise ValueError("an id must not be empty")
    return text


def partition_dir(spark: SparkSession, base: str, **keys) -> str:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return base.rstrip("/") + "".join(f"/{k}={escape(checked_id(v))}" for k, v in keys.items())


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p)) and bool(fs.getFileStatus(p).isDirectory())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as Spark's file metadata spells it (scheme added, encoded)."""
    p, fs = _fs(spark, path)
    return str(fs.makeQualified(p).toUri().toString()).rstrip("/")


HEADER_BYTES = 1 << 16


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of an uncompressed UTF-8 file, or None if it is not one, is
    empty, or the line is blank or longer than ``HEADER_BYTES``."""
    p, fs = _fs(spark, path)
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
        spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getFileStatus(p).isDirectory() or codecs.getCodec(p) is not None:
        return None
    stream = fs.open(p)
    try:
        data = bytes(stream.readNBytes(HEADER_BYTES))
    finally:
        stream.close()
    line, end, _ = data.partition(b"\n")
    try:
        text = line.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text.strip() and (end or len(data) < HEADER_BYTES) and "\r" not in text[:-1] else None


def delete_dataset_dir(spark: SparkSession, root: str, user_id, dataset_id) -> bool:
    """Delete one dataset's folder of a table; refuses any path whose parent is
    not the owner's folder.  A missing folder is not an error."""
    owner, fs = _fs(spark, partition_dir(spark, root, user_id=user_id))
    target, _ = _fs(spark, partition_dir(spark, root, user_id=user_id, dataset_id=dataset_id))
    if not fs.makeQualified(target).getParent().equals(fs.makeQualified(owner)):
        raise ValueError(f"{target} is not a dataset folder of its owner")
    return bool(fs.delete(target, True))


def write_partitions(df: DataFrame, base: str) -> None:
    """Replace every ``(user_id, dataset_id)`` partition present in ``df``
    (which carries both columns) in one job; other partitions stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("user_id", "dataset_id").parquet(base))


def read_partitions(spark: SparkSession, base: str, user_id, dataset_ids,
                    schema: T.StructType) -> DataFrame:
    """Several datasets of one owner, reading only their partition folders
    (no listing of the whole table); ``schema`` includes the string
    partition columns, so folder names are never type-inferred."""
    paths = [partition_dir(spark, base, user_id=user_id, dataset_id=d) for d in dataset_ids]
    return spark.read.schema(schema).option("basePath", base).parquet(*paths)


# --------------------------------------------------------------------------
# landing: the raw lines
# --------------------------------------------------------------------------

def stage_raw(spark: SparkSession, path, staging: str) -> dict:
    """K1, first half: write every line of an upload (a file, a folder of part
    files, or a list of files) with its file and place below ``staging``, and count while writing.

    A line is what stands before a ``\\n``; carriage returns, quotes, blank
    lines and fields too many stay in it.  ``file_size`` tells whether the last
    line had its ``\\n``.  Nothing of the content becomes a column, so no
    header can clash with a column of the store.  Returns ``n_lines``, ``n_files``
    (files with a line) and ``n_rows`` (lines without one header per file),
    observed on the way: the gate needs no read of its own."""
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_size"].alias("file_size"),
        meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"))
    seen = Observation()
    # the files of one upload: as many names as the reader has listed anyway
    lines.observe(seen, F.count(F.lit(1)).alias("n_lines"), F.size(F.collect_set("file")).alias("n_files")) \
        .write.mode("overwrite").parquet(staging)
    counts = {k: seen.get[k] or 0 for k in ("n_lines", "n_files")}
    return counts | {"n_rows": counts["n_lines"] - counts["n_files"]}


def commit_landing(spark: SparkSession, staging: str, base: str, user_id, dataset_id, **increment) -> str:
    """K1, second half: the staged lines replace the dataset's folder, or that of
    one increment of it (a rename)."""
    target = partition_dir(spark, base, user_id=user_id, dataset_id=dataset_id, **increment)
    new, fs = _fs(spark, target)
    fs.mkdirs(new.getParent())
    fs.delete(new, True)
    if not fs.rename(_fs(spark, staging)[0], new):
        raise OSError(f"{staging} could not be moved to {target}")
    return target


def remove(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.delete(p, True))


def land_raw(spark: SparkSession, path: str, base: str, user_id, dataset_id) -> str:
    """K1: keep every line of the upload as it is, under the dataset's folder."""
    staging = f"{base.rstrip('/')}/_staging/{uuid.uuid4().hex}"
    try:
        stage_raw(spark, path, staging)
        return commit_landing(spark, staging, base, user_id, dataset_id)
    finally:
        remove(spark, staging)


def read_landed(spark: SparkSession, base: str, user_id, dataset_id) -> DataFrame:
    """The landed lines of a dataset (``file, file_size, block, seq, line``);
    sorted by the first, third and fourth column they are the files again."""
    landed = spark.read.schema(LANDED_SCHEMA).parquet(partition_dir(spark, base, user_id=user_id, dataset_id=dataset_id))
    return landed.select("file", "file_size", "block", "seq", "line")         # increments are folders of it


# --------------------------------------------------------------------------
# claims: an id belongs to one owner
# --------------------------------------------------------------------------

_CLAIM_LOCK = threading.Lock()


def _claim_path(spark: SparkSession, base: str, dataset_id: str) -> str:
    digest = hashlib.sha256(dataset_id.encode("utf-8", "surrogatepass")).hexdigest()
    return f"{base.rstrip('/')}/{digest[:2]}/{digest}"


def claim_owner(spark: SparkSession, base: str, dataset_id: str) -> str | None:
    """Who holds an id, if anyone."""
    p, fs = _fs(spark, _claim_path(spark, base, dataset_id))
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def claim(spark: SparkSession, base: str, dataset_id: str, user_id: str) -> tuple[str, bool]:
    """Insert-if-absent of an id: (its owner, whether this call made the claim).

    The claim is a file named by the id.  It is written aside and renamed into
    place, which the file system does for one caller only (HDFS refuses to
    rename onto a file); callers of one driver, whose local file system would
    overwrite, take turns.  So of several owners exactly one wins and the others
    read the winner's name, whenever they look."""
    path = _claim_path(spark, base, dataset_id)
    final, fs = _fs(spark, path)
    with _CLAIM_LOCK:
        if (owner := claim_owner(spark, base, dataset_id)) is not None:
            return owner, False
        aside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
        fs.mkdirs(final.getParent())
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(user_id.encode("utf-8", "surrogatepass")))
        finally:
            stream.close()
        if not fs.exists(final) and fs.rename(aside, final):
            return user_id, True
        fs.delete(aside, False)
    return claim_owner(spark, base, dataset_id) or user_id, False


def release(spark: SparkSession, base: str, dataset_id: str, user_id: str) -> bool:
    """Give an id back, if this owner holds it."""
    if claim_owner(spark, base, dataset_id) != user_id:
        return False
    p, fs = _fs(spark, _claim_path(spark, base, dataset_id))
    return bool(fs.delete(p, False))


# --------------------------------------------------------------------------
# catalogue events
# --------------------------------------------------------------------------

_CLOCK = {"last": 0}
_CLOCK_LOCK = threading.Lock()


def next_seq() -> int:
    """A number above all that this process gave out, close to the time in
    microseconds: events of one writer are ordered even where their times tie
    or the clock is set back."""
    with _CLOCK_LOCK:
        _CLOCK["last"] = max(_CLOCK["last"] + 1, time.time_ns() // 1000)
        return _CLOCK["last"]


def append_events(spark: SparkSession, base: str, rows: list[dict]) -> None:
    """K2/K3: append status events (driver-made rows, a few per upload), numbered
    in the order given."""
    rows = [{"seq": next_seq()} | r for r in rows]
    if rows:
        ordered = [tuple(r.get(f.name) for f in CATALOG_EVENT_SCHEMA.fields) for r in rows]
        append_event_frame(spark.createDataFrame(ordered, CATALOG_EVENT_SCHEMA).coalesce(1), base)


def append_event_frame(events: DataFrame, base: str) -> None:
    """Append events made by Spark; columns that are missing are not set."""
    full = events.select(*[(F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in CATALOG_EVENT_SCHEMA.fields])
    full.write.mode("append").partitionBy("user_id").parquet(base)


def read_events(spark: SparkSession, base: str, user_id=None) -> DataFrame:
    """All events, or one owner's (only that folder is listed)."""
    reader = spark.read.schema(CATALOG_EVENT_SCHEMA)
    if user_id is None:
        return reader.parquet(base)
    folder = partition_dir(spark, base, user_id=user_id)
    if not exists(spark, folder):
        return spark.createDataFrame([], CATALOG_EVENT_SCHEMA)
    return reader.option("basePath", base).parquet(folder)


def compact_events(spark: SparkSession, base: str, user_id) -> int:
    """Fold an owner's events into one file.  The files it was made from stay for
    readers that have listed them already, and are removed by the next
    compaction; until then they say what the folded file says, so nothing changes.
    Events appended meanwhile stay, and a crash between the steps is harmless.
    Returns how many files were folded."""
    from dqlens.operators.catalog import fold_events
    note, fs = _fs(spark, partition_dir(spark, base, user_id=user_id) + "/_superseded")
    if fs.exists(note):
        stream = fs.open(note)
        try:
            names = str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split("\n")
        finally:
            stream.close()
        for name in filter(None, names):
            fs.delete(_fs(spark, name)[0], False)
        fs.delete(note, False)
    old = read_events(spark, base, user_id)
    files = old.inputFiles()
    if len(files) < 2:
        return 0
    append_event_frame(fold_events(old).coalesce(1), base)
    stream = fs.create(note, True)
    try:
        stream.write(bytearray("\n".join(files).encode()))
    finally:
        stream.close()
    return len(files)
