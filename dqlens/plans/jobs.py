"""Composite batch jobs: ingest-and-profile (R1), reads (R2), archive (R3).

A job is a short driver function that chains DataFrame operators; all data
work runs on the executors.  What crosses the driver is metadata only: the
uploads it was given, their schemas and their verdicts.
"""

from __future__ import annotations

import datetime as _dt
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.functions import constants as K
from dqlens.functions.expressions import bad_value
from dqlens.operators import catalog as C
from dqlens.operators import profile as P
from dqlens.operators import report as R
from dqlens.operators import state as VS
from dqlens.operators import storage as ST
from dqlens.session import scratch_path
from dqlens.sources import csv as S


class DatasetNotFound(LookupError):
    """The owner has no such dataset."""


class DatasetTaken(ValueError):
    """An id is given twice in a batch, or another owner holds it; ``reasons``
    maps id to reason."""

    def __init__(self, reasons: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in reasons.items()))
        self.reasons = reasons


class UploadRejected(ValueError):
    """The gate turned every upload down; ``reasons`` maps id to reason."""

    def __init__(self, reasons: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in reasons.items()))
        self.reasons = reasons


@dataclass(frozen=True)
class Layout:
    """Table folders below one shared base path."""
    base: str

    @property
    def landing(self) -> str:
        return f"{self.base}/landing"

    @property
    def reports(self) -> str:
        return f"{self.base}/reports"

    @property
    def columns(self) -> str:
        return f"{self.base}/columns"

    @property
    def events(self) -> str:
        return f"{self.base}/catalog_events"

    @property
    def claims(self) -> str:
        return f"{self.base}/claims"

    @property
    def states(self) -> str:
        return f"{self.base}/states"

    @property
    def swept(self) -> str:
        return f"{self.base}/swept"

    @property
    def staging(self) -> str:
        return f"{self.base}/staging"


def _layout(base: str) -> Layout:
    return Layout(base.rstrip("/"))


COLUMNS_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType(), True),
    T.StructField("column_name", T.StringType(), True),
    T.StructField("dtype", T.StringType(), True),
    T.StructField("row_count", T.LongType(), True),
    T.StructField("n_missing", T.LongType(), True),
    T.StructField("n_distinct", T.LongType(), True),
    T.StructField("is_constant", T.BooleanType(), True),
    T.StructField("n_bad", T.LongType(), True),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("dataset_id", T.StringType(), True),
])


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def registration_event(dataset_id: str, user_id: str, filename: str,
                       custom_name: str | None, at: _dt.datetime) -> dict:
    """K2's first catalogue event: status queued, display name (custom name
    stripped, else the file name), counts unknown."""
    custom = (custom_name or "").strip() or None
    return C.status_event(dataset_id, user_id, K.DEFAULT_STATUS, at, name=custom or filename,
                          custom_name=custom, filename=filename, step=K.STEP_INITIAL_ANALYSIS,
                          created_at=at)


def _claimed(spark: SparkSession, layout: Layout, ids: list[str], user_id: str) -> list[str]:
    """Take the ids for the owner; the ones that were free.  An id given twice,
    or held by another owner, is ``DatasetTaken``, and nothing stays claimed."""
    twice = {d: "given twice" for d in ids if ids.count(d) > 1} if len(set(ids)) < len(ids) else {}
    if twice:
        raise DatasetTaken(twice)
    new, taken = [], {}
    for d in ids:
        owner, made = ST.claim(spark, layout.claims, d, user_id)
        if owner != user_id:
            taken[d] = "another owner has a dataset of this id"
        elif made:
            new.append(d)
    if taken:
        for d in new:
            ST.release(spark, layout.claims, d, user_id)
        raise DatasetTaken(taken)
    return new


def register_dataset(spark: SparkSession, layout: Layout, dataset_id: str, user_id: str,
                     filename: str, custom_name: str | None = None) -> None:
    """K2: register one dataset without processing it.  The id is claimed: it
    is unique over all owners (``DatasetTaken`` otherwise)."""
    dataset_id, user_id = ST.checked_id(dataset_id), ST.checked_id(user_id)
    _claimed(spark, layout, [dataset_id], user_id)
    ST.append_events(spark, layout.events,
                     [registration_event(dataset_id, user_id, filename, custom_name, _now())])


def profile_csv(spark: SparkSession, path: str, exact: bool = True, **csv_options) -> DataFrame:
    """A8 on a CSV file or folder: long-form profile (one row per column).

    After the pass that infers the schema one scan of strings gives all of it.
    Options that change how the reader parses values need its own typed scan
    beside the raw one.
    """
    schema = S.read_typed(spark, path, **csv_options).schema
    raw = S.read_raw(spark, path, **csv_options)
    if S.default_parsing(csv_options):
        return P.profile_strings(raw, schema, exact=exact)
    typed = S.read_typed(spark, path, schema=schema, **csv_options)
    return P.profile_columns(typed, raw, schema, exact=exact)


# --------------------------------------------------------------------------
# R2: reads
# --------------------------------------------------------------------------

def current_catalog(spark: SparkSession, base: str, user_id: str | None = None) -> DataFrame:
    """The catalogue now: folded events without removed datasets.  With
    ``user_id`` only that owner's folder is listed and read."""
    return C.current_catalog(ST.read_events(spark, _layout(base).events, user_id))


def compact_catalog(spark: SparkSession, base: str, user_id: str) -> int:
    """Replace an owner's many small event files by one folded file."""
    return ST.compact_events(spark, _layout(base).events, user_id)


def _dataset(spark: SparkSession, base: str, dataset_id: str, user_id: str) -> DataFrame:
    """The catalogue row of one dataset; the id filter reaches the scan."""
    events = ST.read_events(spark, _layout(base).events, user_id)
    return C.current_catalog(events.where(F.col("dataset_id") == F.lit(ST.checked_id(dataset_id))))


def _require(spark: SparkSession, base: str, dataset_id: str, user_id: str) -> DataFrame:
    row = _dataset(spark, base, dataset_id, user_id)
    if row.isEmpty():
        raise DatasetNotFound(f"user {user_id!r} has no dataset {dataset_id!r}")
    return row


def list_datasets(spark: SparkSession, base: str, user_id: str) -> DataFrame:
    return C.catalog_list(current_catalog(spark, base, user_id), str(user_id))


def reports_table(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(R.stored_report_schema()).parquet(_layout(base).reports)


def get_dataset(spark: SparkSession, base: str, dataset_id: str, user_id: str) -> DataFrame:
    """Detail of one dataset with its report (``analysis``) when stored."""
    row = _require(spark, base, dataset_id, user_id)
    reports = _layout(base).reports
    if ST.exists(spark, ST.partition_dir(spark, reports, user_id=user_id, dataset_id=dataset_id)):
        rep = ST.read_partitions(spark, reports, user_id, [dataset_id], R.stored_report_schema())
    else:
        rep = spark.createDataFrame([], R.stored_report_schema())
    return C.dataset_detail(row, rep)


def get_status(spark: SparkSession, base: str, dataset_id: str, user_id: str) -> DataFrame:
    return C.status_view(_require(spark, base, dataset_id, user_id))


# --------------------------------------------------------------------------
# R3: archive
# --------------------------------------------------------------------------

def archive_dataset(spark: SparkSession, base: str, dataset_id: str, user_id: str) -> dict:
    """K5: drop a dataset of its owner: files, report and catalogue entry.

    The dataset is looked up first (``DatasetNotFound`` otherwise).  Landing,
    column profile and report are removed folder by folder; the removal is an
    event, so a later registration of the same id starts afresh.
    """
    layout, dataset_id, user_id = _layout(base), ST.checked_id(dataset_id), ST.checked_id(user_id)
    _require(spark, base, dataset_id, user_id)
    fs_error = None
    for root in (layout.landing, layout.columns, layout.reports, layout.states):
        try:
            ST.delete_dataset_dir(spark, root, user_id, dataset_id)
        except Exception as exc:  # noqa: BLE001 -- reported, not raised
            fs_error = str(exc)
    now = _now()
    ST.append_events(spark, layout.events, [C.status_event(dataset_id, user_id, None, now, deleted_at=now)])
    ST.release(spark, layout.claims, dataset_id, user_id)
    return {"dataset_id": dataset_id, "archived": True, "fs_error": fs_error}


SWEPT_SCHEMA = "dataset_id string, deleted_at timestamp_ntz"


def archive_many(spark: SparkSession, base: str, ids: DataFrame, user_id: str, parallel: int = 16) -> DataFrame:
    """K5 for a table of ids (column ``dataset_id``): ``(dataset_id, archived)``
    of every distinct id; ids that the owner does not have are not archived.

    The removal of all of them is one append of events, so from then on no
    reader sees any; then their folders go (``sweep_removed``).  The number of Spark
    jobs does not depend on the number of ids, and after a crash between the two
    steps a sweep, or the next call, takes up what is left."""
    layout, user_id = _layout(base), ST.checked_id(user_id)
    asked = ids.select(F.col("dataset_id").cast("string").alias("dataset_id")).where(
        "length(dataset_id) > 0").distinct()
    has = current_catalog(spark, base, user_id).select("dataset_id", F.lit(True).alias("archived"))
    # written down first: the events below change what the catalogue says
    path = scratch_path(spark, "archive")
    asked.join(has, "dataset_id", "left").select("dataset_id", F.coalesce("archived", F.lit(False)).alias("archived")) \
        .write.parquet(path)
    found = spark.read.schema("dataset_id string, archived boolean").parquet(path)
    now = F.lit(_now()).cast("timestamp_ntz")
    ST.append_event_frame(found.where("archived").select(
        "dataset_id", F.lit(user_id).alias("user_id"), now.alias("updated_at"), now.alias("deleted_at"),
        F.lit(ST.next_seq()).alias("seq")), layout.events)
    sweep_removed(spark, base, user_id, parallel)
    return found


def sweep_removed(spark: SparkSession, base: str, user_id: str, parallel: int = 16) -> int:
    """Delete the folders of an owner's removed datasets that no sweep has seen
    to yet, and give their ids back; returns how many.  Deleting is a request to
    the file system per folder, made by a few driver threads as the ids stream
    past; a folder that is gone is no error, so a sweep may be repeated."""
    layout, user_id = _layout(base), ST.checked_id(user_id)
    folded = C.fold_events(ST.read_events(spark, layout.events, user_id))
    gone = folded.where("deleted_at IS NOT NULL AND created_at IS NULL").select("dataset_id", "deleted_at")
    mark = ST.partition_dir(spark, layout.swept, user_id=user_id)
    if ST.exists(spark, mark):
        gone = gone.join(spark.read.schema(SWEPT_SCHEMA).parquet(mark), ["dataset_id", "deleted_at"], "left_anti")
    path = scratch_path(spark, "sweep")
    gone.write.parquet(path)
    pending = spark.read.schema(SWEPT_SCHEMA).parquet(path)

    roots = [root for root in (layout.landing, layout.columns, layout.reports, layout.states)
             if ST.exists(spark, ST.partition_dir(spark, root, user_id=user_id))]
    claims = ST.exists(spark, layout.claims)

    def clear(row) -> int:
        for root in roots:
            ST.delete_dataset_dir(spark, root, user_id, row["dataset_id"])
        if claims:
            ST.release(spark, layout.claims, row["dataset_id"], user_id)
        return 1

    rows, n = pending.toLocalIterator(), 0
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        while batch := list(islice(rows, 1000)):
            n += sum(pool.map(inheritable_thread_target(spark)(clear), batch))
    if n:
        pending.write.mode("append").parquet(mark)
    return n


# --------------------------------------------------------------------------
# R1: gate
# --------------------------------------------------------------------------

def _file_name(item: dict) -> str:
    return item.get("filename") or item["path"].rstrip("/").split("/")[-1]


def wrong_kind(spark: SparkSession, item: dict) -> str | None:
    """Turned down if neither the name nor the MIME type is one of a CSV file (a
    folder of part files without a given name has none to check)."""
    named = item.get("filename") or item.get("mime") or not ST.is_folder(spark, item["path"])
    if named and not _file_name(item).lower().endswith(K.CSV_SUFFIX) and item.get("mime") not in K.ALLOWED_MIME:
        return "not a CSV file"
    return None


def too_long(n_rows: int, max_rows: int | None) -> str | None:
    """Turned down if there are more than ``max_rows`` physical lines after the headers."""
    return f"more than {max_rows} rows ({n_rows})" if max_rows is not None and n_rows > max_rows else None


def gate_upload(spark: SparkSession, item: dict, max_rows: int | None = None) -> str | None:
    """Why an upload is turned down, or None.  (An ingest counts while it lands;
    this is the gate alone, with a read of its own.)"""
    if why := wrong_kind(spark, item):
        return why
    if max_rows is not None and ST.exists(spark, item["path"]):
        return too_long(S.row_limit_gate(spark, item["path"], max_rows).first()["n_rows"], max_rows)
    return None


# --------------------------------------------------------------------------
# R1: ingest and profile
# --------------------------------------------------------------------------

def ingest_and_profile(spark: SparkSession, base: str, path: str, dataset_id: str,
                       user_id: str, filename: str | None = None,
                       custom_name: str | None = None, max_rows: int | None = None,
                       exact: bool = True, register: bool = True, schema=None, wanted=None,
                       mime: str | None = None, **csv_options) -> DataFrame:
    """R1: gate -> register -> land -> profile -> store -> catalogue update of
    one upload: ``ingest_many`` on a batch of one."""
    item = {"path": path, "dataset_id": dataset_id, "filename": filename, "custom_name": custom_name,
            "schema": schema, "wanted": wanted, "mime": mime}
    return ingest_many(spark, base, [item], user_id, exact=exact, register=register, max_rows=max_rows,
                       **csv_options)


def _in_parallel(spark: SparkSession, fn, items: list, parallel: int) -> list:
    """``fn`` over ``items`` from up to ``parallel`` driver threads (each
    submits its own Spark jobs); per item (result, None) or (None, error)."""
    def one(item):
        try:
            return fn(item), None
        except Exception as exc:  # noqa: BLE001 -- this upload fails alone
            return None, exc
    if parallel <= 1 or len(items) <= 1:
        return [one(it) for it in items]
    # threads inherit the caller's local properties (job group, pool), so
    # cancelling the caller's job group also cancels these jobs
    with ThreadPoolExecutor(max_workers=min(parallel, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(one), items))


def _plain_path(path: Column) -> Column:
    """One spelling of a place: "file:///x" is "file:/x"."""
    return F.when(path.startswith("file:/"), F.concat(F.lit("file:/"), F.ltrim(F.substr(path, F.lit(7)), F.lit("/")))) \
        .otherwise(path)


def _keyed_scan(spark: SparkSession, places: list[str], folders: bool, schema: T.StructType,
                csv_options: dict) -> DataFrame:
    """One CSV scan of many places of one schema -- all of them files, or all
    folders of part files -- with the number of the place as last column."""
    reader = spark.read.option("header", True).schema(schema)
    for k, v in csv_options.items():
        reader = reader.option(k, v)
    frame = reader.csv(places)
    names = [f"c{i}" for i in range(len(schema.fields))]
    if len(places) == 1:
        return frame.toDF(*names).withColumn("_place", F.lit(0))
    frame = frame.select("*", _plain_path(F.col("_metadata.file_path")).alias("_root")).toDF(*names, "_root")
    if folders:
        frame = frame.withColumn("_root", F.expr("left(_root, length(_root) - length(substring_index(_root, '/', -1)) - 1)"))
    # one row per place, broadcast: a shuffle by place would hand a large upload to one task
    numbers = spark.createDataFrame(list(enumerate(places)), "_place int, _root string")
    numbers = numbers.withColumn("_root", _plain_path(F.col("_root")))
    unknown = F.raise_error(F.concat(F.lit("file of no upload: "), F.col("_root"))).cast("int")
    return frame.join(F.broadcast(numbers), "_root", "left").select(*names, F.coalesce("_place", unknown).alias("_place"))


def _wanted_type(t) -> T.DataType:
    return T._parse_datatype_string(t) if isinstance(t, str) else t


def _bad_counts(raw: DataFrame, wanted: list[T.DataType]) -> DataFrame | None:
    """``(_place, position, n_bad)`` of a keyed scan of strings."""
    checks = [(i, t) for i, t in enumerate(wanted) if not isinstance(t, T.StringType)]
    if not checks:
        return None
    row = raw.groupBy("_place").agg(*[F.count_if(bad_value(F.col(f"c{i}"), t)).alias(f"b{i}") for i, t in checks])
    structs = ", ".join(f"named_struct('{P.POSITION}', {i}, 'n_bad', b{i})" for i, _ in checks)
    return row.selectExpr("_place", f"inline(array({structs}))")


def _group_stats(spark: SparkSession, roots: dict[str, str], folders: bool, schema: T.StructType,
                 wanted: list[T.DataType], exact: bool, csv_options: dict) -> DataFrame:
    """``(_id, position, n_distinct, n_rows, n_miss, n_bad)`` of uploads of one
    schema.  A path that several uploads share is read and counted once, and
    each of them gets its counts."""
    places = {d: ST.qualified(spark, p) for d, p in roots.items()}
    number = {p: i for i, p in enumerate(dict.fromkeys(places.values()))}
    owner = spark.createDataFrame([(number[p], d) for d, p in places.items()], "_place int, _id string")
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = _keyed_scan(spark, list(number), folders, strings, csv_options)
    if S.default_parsing(csv_options):
        stats = P.string_stats(raw, schema, wanted, "_place", exact)
    else:
        # the reader's own parsing: a typed scan beside the raw one
        typed = _keyed_scan(spark, list(number), folders, schema, csv_options)
        stats = (P.keyed_stats if exact else P.keyed_estimates)(typed, "_place").drop("n_bad")
        bad = _bad_counts(raw, wanted)
        stats = stats.withColumn("n_bad", F.lit(0)) if bad is None else stats.join(bad, ["_place", P.POSITION], "left")
    return stats.join(F.broadcast(owner), "_place").drop("_place")


def _profiles(spark: SparkSession, uploads: dict[str, dict], exact: bool, csv_options: dict) -> DataFrame:
    """Long-form profiles of a batch (``dataset_id`` column).  Uploads of one
    schema are one scan with the dataset as key, so the plan grows with the
    number of different schemas, not of uploads."""
    groups: dict[tuple, list[str]] = {}
    for d, u in uploads.items():
        if u["schema"].fields:
            groups.setdefault((u["folder"], u["schema"].json(), *(t.json() for t in u["wanted"])), []).append(d)
    meta = spark.createDataFrame([(d, i, f.name, f.dataType.simpleString()) for d, u in uploads.items()
                                  for i, f in enumerate(u["schema"].fields)],
                                 f"_id string, {P.POSITION} int, {P.NAME} string, dtype string")
    stats = None
    for (folders, *_), ids in groups.items():
        first = uploads[ids[0]]
        part = _group_stats(spark, {d: uploads[d]["path"] for d in ids}, folders, first["schema"], first["wanted"],
                            exact, csv_options)
        stats = part if stats is None else stats.unionByName(part)
    if stats is None:
        stats = spark.createDataFrame(
            [], f"_id string, {P.POSITION} int, n_distinct bigint, n_rows bigint, n_miss bigint, n_bad bigint")
    out = meta.join(stats, ["_id", P.POSITION], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select(P.POSITION, P.NAME, "dtype", count("n_rows").alias("row_count"),
                      count("n_miss").alias("n_missing"), count("n_distinct").alias("n_distinct"),
                      (count("n_distinct") <= 1).alias("is_constant"), count("n_bad").alias("n_bad"),
                      F.col("_id").alias("dataset_id"))


def _store_reports(spark: SparkSession, layout: Layout, user_id: str, uploads: dict[str, dict]) -> None:
    """Fold the stored column profiles of a batch into one report per dataset,
    written with one dynamic-overwrite job."""
    profiled = [d for d, u in uploads.items() if u["schema"].fields]
    stored = (ST.read_partitions(spark, layout.columns, user_id, profiled, COLUMNS_SCHEMA)
              if profiled else spark.createDataFrame([], COLUMNS_SCHEMA))
    reports = R.report_document(stored, ["user_id", "dataset_id"])
    empty = [(user_id, d) for d, u in uploads.items() if not u["schema"].fields]
    if empty:
        reports = reports.unionByName(R.empty_reports(spark, empty))
    places = spark.createDataFrame([(d, u["landed"]) for d, u in uploads.items()], "dataset_id string, hdfs_path string")
    reports = reports.join(places, "dataset_id").select(
        F.current_timestamp().cast("timestamp_ntz").alias("generated_at"), "hdfs_path", *reports.columns)
    ST.write_partitions(reports, layout.reports)


def _infer_together(spark: SparkSession, items: list[dict]) -> dict[str, T.StructType]:
    """Schemas of the plain files among several uploads, from one job.  Folders,
    and what that job cannot tell, are left to an inference of their own."""
    if len(items) < 2:
        return {}
    try:
        headers = {it["dataset_id"]: ST.first_line(spark, it["path"]) for it in items}
        headers = {d: h for d, h in headers.items() if h is not None}
        return S.infer_many(spark, {it["dataset_id"]: ST.qualified(spark, it["path"]) for it in items}, headers)
    except Exception:  # noqa: BLE001 -- a file that cannot be read fails alone, in its own step
        return {}


def _profile_apart(spark: SparkSession, layout: Layout, user_id: str, uploads: dict[str, dict], exact: bool,
                   csv_options: dict) -> dict[str, Exception]:
    """Profile and store a batch together; the uploads that cannot be, with
    their errors.  Where the shared job fails the batch is halved, and what a half
    has stored stays: k bad ones of n cost about 2 k log2(n) more jobs."""
    try:
        prof = _profiles(spark, uploads, exact, csv_options)
        ST.write_partitions(prof.withColumn("user_id", F.lit(user_id)), layout.columns)
        _store_reports(spark, layout, user_id, uploads)
        return {}
    except Exception as exc:  # noqa: BLE001 -- one upload fails alone
        ids = list(uploads)
        if len(ids) == 1:
            return {ids[0]: exc}
    half = len(ids) // 2
    failed: dict[str, Exception] = {}
    for part in (ids[:half], ids[half:]):
        failed |= _profile_apart(spark, layout, user_id, {d: uploads[d] for d in part}, exact, csv_options)
    return failed


def ingest_many(spark: SparkSession, base: str, items: list[dict], user_id: str,
                exact: bool = True, register: bool = True, parallel: int = 8,
                max_rows: int | None = None, **csv_options) -> DataFrame:
    """Ingest and profile several uploads of one owner together.

    ``items``: dicts with ``path``, ``dataset_id`` and optionally ``filename``,
    ``custom_name``, ``mime``, ``schema`` (a known layout skips inference) and
    ``wanted`` (name -> type to check the raw values against; default the
    schema).  An id that occurs twice, or that another owner holds, is
    ``DatasetTaken`` before anything is written.  Uploads that the gate turns
    down are not registered and leave nothing behind; if it turns all down,
    ``UploadRejected`` is raised.  Lines are counted while they are landed
    beside the store, and a rename makes them the dataset's: the gate reads
    nothing by itself.  Each status change of the batch is one append; profiles
    and reports are written with one job each, and the schemas of plain files are
    inferred in one.  What stays per upload is what depends on its own file -- the
    landing, and the inference of folders -- submitted from ``parallel`` driver threads.

    Idempotent per dataset id.  An upload that cannot be read, landed or
    profiled fails alone (its own ``failed`` event with the whole message); the
    others go on.  If every upload failed, the first error is raised again.
    ``register=False`` re-runs already registered datasets.  Returns the stored
    reports of the datasets that succeeded.
    """
    layout, user_id = _layout(base), ST.checked_id(user_id)
    items = [dict(it, dataset_id=ST.checked_id(it["dataset_id"])) for it in items]
    if not items:
        raise ValueError("nothing to ingest")

    def event(dataset_id: str, status: str, **extra) -> dict:
        return C.status_event(dataset_id, user_id, status, _now(), **extra)

    def begun(todo: list[dict]) -> list[dict]:
        now = _now()
        first = [registration_event(it["dataset_id"], user_id, _file_name(it), it.get("custom_name"), now)
                 for it in todo] if register else []
        return first + [event(it["dataset_id"], "uploading_hdfs") for it in todo]

    new = _claimed(spark, layout, [it["dataset_id"] for it in items], user_id)
    kinds = _in_parallel(spark, lambda it: wrong_kind(spark, it), items, parallel)
    reasons = {it["dataset_id"]: why for it, (why, exc) in zip(items, kinds) if exc is None and why}
    failed: dict[str, Exception] = {}

    def accepted() -> list[dict]:
        return [it for it in items if it["dataset_id"] not in reasons]

    def step(fn, todo: list[dict]) -> dict:
        done = _in_parallel(spark, fn, todo, parallel)
        failed.update({it["dataset_id"]: exc for it, (_, exc) in zip(todo, done) if exc is not None})
        return {it["dataset_id"]: got for it, (got, exc) in zip(todo, done) if exc is None}

    def infer(it: dict) -> dict:
        schema = inferred.get(it["dataset_id"])
        if schema is None:
            schema = S.read_typed(spark, it["path"], schema=it.get("schema"), **csv_options).schema
        wanted = {n: _wanted_type(t) for n, t in (it.get("wanted") or {}).items()}
        if absent := set(wanted) - set(schema.names):
            raise ValueError(f"no such column to check: {', '.join(sorted(absent))}")
        return {"path": it["path"], "schema": schema, "folder": ST.is_folder(spark, it["path"]),
                "wanted": [wanted.get(f.name, f.dataType) for f in schema.fields]}

    staging = f"{layout.staging}/{uuid.uuid4().hex}"
    place = {it["dataset_id"]: f"{staging}/{i}" for i, it in enumerate(items)}
    gated = max_rows is not None
    try:
        if not gated:
            ST.append_events(spark, layout.events, begun(accepted()))
        staged = step(lambda it: ST.stage_raw(spark, it["path"], place[it["dataset_id"]]), accepted())
        reasons |= {d: why for d, counts in staged.items() if (why := too_long(counts["n_rows"], max_rows))}
        if not accepted():
            raise UploadRejected(reasons)
        if gated:
            ST.append_events(spark, layout.events, begun(accepted()))
        landed = step(lambda it: ST.commit_landing(spark, place[it["dataset_id"]], layout.landing, user_id, it["dataset_id"]),
                      [it for it in accepted() if it["dataset_id"] in staged])
        ST.append_events(spark, layout.events, [event(i, "analyzing", hdfs_path=p) for i, p in landed.items()])
        todo = [it for it in accepted() if it["dataset_id"] in landed]
        inferred = _infer_together(spark, [it for it in todo if it.get("schema") is None]) if not csv_options else {}
        uploads = step(infer, todo)
        uploads = {d: u | {"landed": landed[d]} for d, u in uploads.items()}
        if uploads:
            failed |= _profile_apart(spark, layout, user_id, uploads, exact, csv_options)
        good = [d for d in uploads if d not in failed]
        ST.append_events(spark, layout.events, [event(i, "failed", error_message=str(e)) for i, e in failed.items()])
        if not good:
            raise next(iter(failed.values()))
        stored = ST.read_partitions(spark, layout.reports, user_id, good, R.stored_report_schema())
        ST.append_event_frame(stored.select(
            "dataset_id", "user_id", F.lit(_now()).cast("timestamp_ntz").alias("updated_at"),
            F.lit(ST.next_seq()).alias("seq"), F.lit("done").alias("status"), "row_count", "column_count"), layout.events)
        return stored
    finally:
        ST.remove(spark, staging)
        for d in set(new) & set(reasons):
            ST.release(spark, layout.claims, d, user_id)


# --------------------------------------------------------------------------
# R1 for datasets that gain files
# --------------------------------------------------------------------------

STATE_SCHEMA = VS.VALUE_FIELDS + ", user_id string, dataset_id string, increment string"


def _header(spark: SparkSession, path: str) -> list[str]:
    line = ST.first_line(spark, path)
    if line is None or '"' in line or line.startswith("\ufeff"):
        return S.read_raw(spark, path).columns
    return S.safe_names([c or None for c in line.rstrip("\r").split(",")])


def _known_names(spark: SparkSession, layout: Layout, user_id: str, ids: list[str]) -> dict[str, list[str] | None]:
    """Column names of the datasets that are profiled already; None for those
    without a state, as after an ingest of the whole."""
    ids = [d for d in ids if ST.exists(spark, ST.partition_dir(spark, layout.columns, user_id=user_id, dataset_id=d))]
    without = [d for d in ids if not ST.exists(spark, ST.partition_dir(spark, layout.states, user_id=user_id, dataset_id=d))]
    ids = [d for d in ids if d not in without]
    if not ids:
        return dict.fromkeys(without)
    rows = ST.read_partitions(spark, layout.columns, user_id, ids, COLUMNS_SCHEMA).groupBy("dataset_id").agg(
        F.sort_array(F.collect_list(F.struct(P.POSITION, P.NAME))).alias("c")).collect()
    return dict.fromkeys(without) | {r["dataset_id"]: [c[P.NAME] for c in r["c"]] for r in rows}


def _add_states(spark: SparkSession, layout: Layout, user_id: str, items: list[dict], names: dict[str, list[str]]) -> None:
    """Count the values of the new files of a batch (one scan) and write them as
    the items' increments; an increment that is written again replaces itself."""
    width = max(len(names[it["dataset_id"]]) for it in items)
    increments = [(it, step) for it in items for step in it["files"]]
    files = [(f, i) for i, (it, step) in enumerate(increments) for f in it["files"][step]]
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).option("header", True).csv([f for f, _ in files])
    # as many rows as the reader has listed files, broadcast: a shuffle by file would hand a large one to one task
    owner = spark.createDataFrame([(re.sub("^file:/+", "file:/", ST.qualified(spark, f)), i) for f, i in files],
                                  "_file string, _increment int")
    keyed = raw.withColumn("_file", _plain_path(F.col("_metadata.file_path"))).join(F.broadcast(owner), "_file").drop("_file")
    whose = spark.createDataFrame([(i, it["dataset_id"], step) for i, (it, step) in enumerate(increments)],
                                  "_increment int, dataset_id string, increment string")
    state = VS.value_state(keyed, ["_increment"]).join(F.broadcast(whose), "_increment").drop("_increment") \
        .withColumn("user_id", F.lit(user_id))
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("user_id", "dataset_id", "increment").parquet(layout.states)


def ingest_increments(spark: SparkSession, base: str, items: list[dict], user_id: str, parallel: int = 8) -> DataFrame:
    """Ingest datasets that gain files, reading the new files only.

    ``items``: dicts with ``path`` (the dataset's folder or file), ``dataset_id``,
    ``files`` (the new ones: increment -> files) and optionally ``filename``.  An
    increment is a name for files that came together; when it is given again, as
    after a crash, it replaces itself, so a file must keep its increment.  The new
    files are landed and their values are counted; the profile is made from the counts of
    all increments (``operators.state``) and equals that of the whole folder.  The
    default dialect only.

    A dataset whose header changed, or whose types the values do not tell, or that
    has a profile but no counts, is profiled again from all of its files, and so is every dataset of a batch whose
    common step failed (``ingest_many``, where what fails fails alone).  If every
    dataset failed, the first error is raised.  Returns the stored reports of the others."""
    layout, user_id = _layout(base), ST.checked_id(user_id)
    items = [dict(it, dataset_id=ST.checked_id(it["dataset_id"])) for it in items]
    ids = [it["dataset_id"] for it in items]
    _claimed(spark, layout, ids, user_id)
    full: dict[str, dict] = {}
    staging = f"{layout.staging}/{uuid.uuid4().hex}"
    stored = None
    try:
        names = {it["dataset_id"]: got for it, (got, exc) in zip(items, _in_parallel(
            spark, lambda it: _header(spark, next(iter(it["files"].values()))[0]), items, parallel)) if exc is None}
        known = _known_names(spark, layout, user_id, ids)
        full = {it["dataset_id"]: it for it in items
                if not names.get(it["dataset_id"]) or known.get(it["dataset_id"], names[it["dataset_id"]]) != names[it["dataset_id"]]}
        todo = [it for it in items if it["dataset_id"] not in full]
        if todo:
            now = _now()
            ST.append_events(spark, layout.events, [
                registration_event(it["dataset_id"], user_id, _file_name(it), None, now) for it in todo
                if it["dataset_id"] not in known] + [
                C.status_event(it["dataset_id"], user_id, "uploading_hdfs", now) for it in todo])

            def land(it: dict) -> str:
                for step, files in it["files"].items():
                    place = f"{staging}/{ids.index(it['dataset_id'])}-{step}"
                    ST.stage_raw(spark, files, place)
                    ST.commit_landing(spark, place, layout.landing, user_id, it["dataset_id"], increment=step)
                return ST.partition_dir(spark, layout.landing, user_id=user_id, dataset_id=it["dataset_id"])

            landed = {}
            for it, (place, exc) in zip(todo, _in_parallel(spark, land, todo, parallel)):
                if exc is None:
                    landed[it["dataset_id"]] = place
                else:
                    full[it["dataset_id"]] = it
            todo = [it for it in todo if it["dataset_id"] in landed]
        if todo:
            ST.append_events(spark, layout.events, [C.status_event(d, user_id, "analyzing", _now(), hdfs_path=p)
                                                    for d, p in landed.items()])
            _add_states(spark, layout, user_id, todo, names)
            state = ST.read_partitions(spark, layout.states, user_id, list(landed), T._parse_datatype_string(STATE_SCHEMA))
            columns = spark.createDataFrame([(d, i, n) for d in landed for i, n in enumerate(names[d])],
                                            f"dataset_id string, {P.POSITION} int, {P.NAME} string")
            prof = VS.profile_of_state(state.drop("user_id", "increment"), columns, ["dataset_id"])
            # written beside the store first: only what its values tell is taken
            path = scratch_path(spark, "increment-profiles")
            prof.write.parquet(path)
            prof = spark.read.schema(prof.schema).parquet(path)
            vague = {r["dataset_id"] for r in prof.where("dtype IS NULL").select("dataset_id").distinct().collect()}
            full |= {it["dataset_id"]: it for it in todo if it["dataset_id"] in vague}
            good = [d for d in landed if d not in vague]
            if good:
                owner = spark.createDataFrame([(d, user_id) for d in good], "dataset_id string, user_id string")
                ST.write_partitions(prof.join(owner, "dataset_id").select(*[
                    F.col(f.name).cast(f.dataType) for f in COLUMNS_SCHEMA.fields]), layout.columns)
                _store_reports(spark, layout, user_id, {
                    d: {"landed": landed[d], "schema": T.StructType([T.StructField(n, T.StringType()) for n in names[d]])}
                    for d in good})
                stored = ST.read_partitions(spark, layout.reports, user_id, good, R.stored_report_schema())
                ST.append_event_frame(stored.select(
                    "dataset_id", "user_id", F.lit(_now()).cast("timestamp_ntz").alias("updated_at"),
                    F.lit(ST.next_seq()).alias("seq"), F.lit("done").alias("status"), "row_count", "column_count"), layout.events)
    except Exception:  # noqa: BLE001 -- the whole ingest below tells which dataset is to blame
        full, stored = {it["dataset_id"]: it for it in items}, None
    finally:
        ST.remove(spark, staging)
    if full:
        for d in full:      # a state that was not taken is counted anew next time
            ST.delete_dataset_dir(spark, layout.states, user_id, d)
        try:
            again = ingest_many(spark, base, [{k: v for k, v in it.items() if k != "files"}
                                              for it in full.values()], user_id, parallel=parallel)
        except Exception:
            if stored is None:                  # else they have their failed events
                raise
            return stored
        stored = again if stored is None else stored.unionByName(again)
    return stored
