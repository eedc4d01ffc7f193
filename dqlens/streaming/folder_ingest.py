"""Profile every dataset that lands in a directory, once per run.

A dataset is what sits directly in the watched folder: a CSV file, or a
folder of CSV part files (what a Spark job writes).  The file stream
(``binaryFile`` without its ``content`` column, so no bytes are read by the
listing) only writes down which files are new, in a table below the stream's
checkpoint; ``max_files_per_trigger`` bounds one listing step and nothing
else.  When the stream has seen everything available, the datasets with new
files are grouped by Spark, each is ingested once (however many steps its
files came in), and a second table says up to which step it is done.  A run
that dies in between leaves its datasets pending for the next one.

A folder that receives more files later is not read again: the new files are
counted and its profile comes from the counts of all (``jobs.ingest_increments``).
With CSV options or estimated counts every run reads the whole folder.

Dataset ids are the SHA-256 of the path, so more files, or a batch that is
retried, replace the same report.
"""

from __future__ import annotations

import hashlib
from itertools import groupby, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqlens.functions.expressions import is_csv_file
from dqlens.operators import storage as ST
from dqlens.plans.jobs import ingest_increments, ingest_many
from dqlens.session import scratch_path

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
NEW_SCHEMA = "dataset string, file string, step bigint"
DONE_SCHEMA = "dataset string, step bigint"
BATCH = 256      # datasets that one ingest job takes together


def dataset_id_for(folder: str) -> str:
    """Stable id of a dataset path."""
    return hashlib.sha256(folder.encode("utf-8")).hexdigest()


def _datasets(files: DataFrame, root: str) -> DataFrame:
    """The CSV files below ``root`` and their datasets: the first path component."""
    name = F.element_at(F.split("path", "/"), -1)
    rel = F.expr(f"substring(path, {len(root) + 2})")
    dataset = F.concat(F.lit(root + "/"), F.element_at(F.split(rel, "/"), 1))
    return files.where(is_csv_file(name) & F.col("path").startswith(root + "/")) \
        .select(dataset.alias("dataset"), F.col("path").alias("file")).distinct()


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if ST.exists(spark, path) else spark.createDataFrame([], schema)


def ingest_folder_stream(spark: SparkSession, source_dir: str, base: str, user_id: str,
                         checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                         exact: bool = True, **csv_options) -> DataFrame:
    """Run the folder stream until everything available now is processed.

    Returns the datasets ingested by this run (column ``dataset``).
    ``checkpoint`` defaults to a fresh folder below the shared checkpoint
    root; pass a fixed one to make later runs skip what earlier runs saw.
    """
    checkpoint = (checkpoint or scratch_path(spark, "folder-stream-ckpt")).rstrip("/")
    new_path, done_path = f"{checkpoint}-new", f"{checkpoint}-done"
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("recursiveFileLookup", True))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    p, fs = ST._fs(spark, source_dir)
    root = str(fs.makeQualified(p).toString()).rstrip("/")

    def note(batch: DataFrame, step: int) -> None:
        # a step that is repeated writes the same folder again
        _datasets(batch, root).select("dataset", "file", F.lit(step).cast("bigint").alias("step")) \
            .write.mode("overwrite").parquet(f"{new_path}/at={step}")

    query = (reader.load(source_dir).select("path").writeStream.foreachBatch(note)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()

    done = _table(spark, done_path, DONE_SCHEMA).groupBy("dataset").agg(F.max("step").alias("done"))
    pending_path = scratch_path(spark, "folder-stream-pending")
    files = _table(spark, new_path, NEW_SCHEMA).join(done, "dataset", "left").where("done IS NULL OR done < step")
    files.groupBy("dataset").agg(F.max("step").alias("step"), F.sort_array(F.collect_set(F.struct("step", "file"))).alias("files")) \
        .write.parquet(pending_path)
    pending = spark.read.schema(f"{DONE_SCHEMA}, files array<struct<step:bigint,file:string>>").parquet(pending_path)
    rows = pending.orderBy("dataset").toLocalIterator()
    while batch := list(islice(rows, BATCH)):
        items = [{"path": r["dataset"], "dataset_id": dataset_id_for(r["dataset"]),
                  "filename": r["dataset"].split("/")[-1], "mime": "text/csv"} for r in batch]
        if exact and not csv_options:
            # a file belongs to the listing step that found it, also when a run is repeated
            ingest_increments(spark, base, [it | {"files": {
                str(step): [f["file"] for f in fs] for step, fs in groupby(r["files"], lambda f: f["step"])}}
                for it, r in zip(items, batch)], user_id)
        else:
            ingest_many(spark, base, items, user_id, exact=exact, **csv_options)
        spark.createDataFrame([(r["dataset"], r["step"]) for r in batch], DONE_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(done_path)
    return pending.select("dataset")
