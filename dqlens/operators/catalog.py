"""Dataset catalogue and report tables as plain DataFrame operations.

Storage model (Parquet has no in-place update):

* ``catalog_events``: append-only rows ``(dataset_id, user_id, updated_at,
  status, <other catalogue fields or null>)``.  Registering a dataset appends
  its first event; every status change appends one with only the fields it
  sets.  The current catalogue is a fold of the events: for every field, the
  value of the latest event that set it (a partial aggregate,
  so a dataset with many events never gathers them in one task).
* ``reports``: one row per dataset, partitioned by ``user_id``; storing a
  report overwrites its partition dynamically, so redelivery is idempotent.

Both tables are partitioned by ``user_id``: an owner's listing prunes to one
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqlens.functions import constants as K
from dqlens.functions.expressions import (clean_custom_name, display_name, progress_of,
                                          status_label, step_label)

CATALOG_FIELDS = ("name", "custom_name", "filename", "status", "step", "row_count",
                  "column_count", "hdfs_path", "error_message", "created_at")

LISTING_FIELDS = ("dataset_id", "name", "filename", "custom_name", "row_count",
                  "column_count", "step", "status", "created_at")


def with_names(frame: DataFrame, custom_col: str = "custom_raw",
               filename_col: str = "filename") -> DataFrame:
    """Registration naming: stored ``custom_name`` (stripped, empty -> null)
    and display ``name`` (custom name, else the file name)."""
    raw = F.col(custom_col)
    return (frame.withColumn("custom_name", clean_custom_name(raw))
            .withColumn("name", display_name(raw, F.col(filename_col))))


def catalog_list(catalog: DataFrame, user_id) -> DataFrame:
    """An owner's datasets, newest first (ties: higher id first).

    The owner filter reaches the scan (partition pruning on ``user_id`` for
    the stored table, parquet row-group pruning otherwise).
    """
    return (catalog.where(F.col("user_id") == F.lit(user_id))
            .select(*LISTING_FIELDS)
            .orderBy(F.col("created_at").desc(), F.col("dataset_id").desc()))


def catalog_list_all(catalog: DataFrame) -> DataFrame:
    """Every owner's listing at once: by owner, newest first (ties: higher
    id first).  One global sort: the range partitioner samples the whole
    key, so an owner with a third of all datasets spans many tasks instead
    of landing in one."""
    return (catalog.select("user_id", *LISTING_FIELDS)
            .orderBy(F.col("user_id"), F.col("created_at").desc(), F.col("dataset_id").desc()))


def dataset_detail(catalog: DataFrame, reports: DataFrame, dataset_id=None,
                   user_id=None, report_cols: list[str] | None = None) -> DataFrame:
    """Catalogue rows with their report attached when one exists.

    Equi left outer join on ``(dataset_id, user_id)``.  With ids given this
    is the point lookup of one dataset: the filter is pushed into both sides
    by Catalyst.  Without ids it is the bulk form (every dataset); the join
    then shuffles both sides on the key, or AQE broadcasts the side whose
    materialised size is under the broadcast threshold.
    """
    info = catalog
    rep = reports
    if dataset_id is not None:
        info = info.where(F.col("dataset_id") == F.lit(dataset_id))
        rep = rep.where(F.col("dataset_id") == F.lit(dataset_id))
    if user_id is not None:
        info = info.where(F.col("user_id") == F.lit(user_id))
        rep = rep.where(F.col("user_id") == F.lit(user_id))
    keep = report_cols or [c for c in rep.columns if c not in ("dataset_id", "user_id")]
    rep = rep.select("dataset_id", "user_id", F.struct(*keep).alias("analysis"))
    return info.join(rep, ["dataset_id", "user_id"], "left")


def status_view(catalog: DataFrame) -> DataFrame:
    """Status answer per dataset: status (absent -> queued), step, progress,
    error, update time and the display labels."""
    status = F.coalesce(F.col("status"), F.lit(K.DEFAULT_STATUS))
    return catalog.select(
        "dataset_id",
        status.alias("status"),
        F.col("step"),
        progress_of(F.col("status")).alias("progress"),
        F.col("error_message"),
        F.col("updated_at"),
        status_label(status).alias("status_label"),
        step_label(F.col("step")).alias("step_label"),
    )


def fold_events(events: DataFrame, fields=CATALOG_FIELDS) -> DataFrame:
    """Fold status events into one row per dataset.

    For each field: the value carried by the latest event that set it (null
    values mean "not set").  Of events with one time the one with the highest
    number (``seq``, where events have it) is the latest; what ties even then is
    decided by the value.  ``updated_at`` is the latest event time.  A
    removal (``deleted_at``) is an event too: fields set up to the latest
    removal are forgotten, so a dataset that is ingested again starts afresh.
    The fold of folded rows and newer events is the fold of all events, which
    is what a compacted catalogue relies on.  Partial aggregation first: a
    dataset with many events crosses the shuffle once per task.
    """
    present = [f for f in fields if f in events.columns]
    ts = F.col("updated_at")
    numbered = ["seq"] if "seq" in events.columns else []
    aggs = [F.max(F.when(F.col(f).isNotNull(), F.struct(ts.alias("at"), *numbered, F.col(f).alias("v")))).alias(f)
            for f in present]
    if "deleted_at" in events.columns:
        gone = F.struct(F.col("deleted_at").alias("at"), *numbered)
        aggs.append(F.max(F.when(F.col("deleted_at").isNotNull(), gone)).alias("gone"))
    aggs += [F.max(c).alias(c) for c in numbered]
    folded = events.groupBy("dataset_id", "user_id").agg(*aggs, F.max(ts).alias("updated_at"))
    if "deleted_at" not in events.columns:
        return folded.select("dataset_id", "user_id", *[F.col(f)["v"].alias(f) for f in present], "updated_at", *numbered)
    when = lambda f: F.struct(F.col(f)["at"].alias("at"), *[F.col(f)[c].alias(c) for c in numbered])
    alive = lambda f: F.col("gone").isNull() | (when(f) > F.col("gone"))
    return folded.select("dataset_id", "user_id", *[F.when(alive(f), F.col(f)["v"]).alias(f) for f in present],
                         "updated_at", F.col("gone")["at"].alias("deleted_at"), *numbered)


def current_catalog(events: DataFrame, fields=CATALOG_FIELDS) -> DataFrame:
    """The current catalogue row of every dataset that is registered and not
    removed since."""
    folded = fold_events(events, fields).drop("seq")
    if "deleted_at" not in folded.columns:
        return folded
    # a late status of a removed dataset does not bring it back: a registration does
    return folded.where(F.col("deleted_at").isNull() | F.col("created_at").isNotNull()).drop("deleted_at")


def name_of(ids: DataFrame, catalog: DataFrame, default: str) -> DataFrame:
    """``(dataset_id, name)``: the catalogue name of each id, else ``default``."""
    names = catalog.groupBy("dataset_id").agg(F.min("name").alias("name"))
    return ids.select("dataset_id").join(names, "dataset_id", "left").select(
        "dataset_id", F.coalesce("name", F.lit(default)).alias("name"))


def status_event(dataset_id, user_id, status: str, at, **extra) -> dict:
    """One event row (driver-side dict) for a status change."""
    row = {"dataset_id": dataset_id, "user_id": user_id, "status": status, "updated_at": at}
    row.update(extra)
    return row


def archive(catalog: DataFrame, reports: DataFrame, drop: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove datasets: rows of both tables whose id is in ``drop``.

    ``drop`` holds ``(dataset_id, user_id)``; the owner must match, as in the
    reference.  Both results are ``left_anti`` joins, which never duplicate
    rows; Spark plans them as shuffle joins, AQE broadcasts ``drop`` once its
    materialised size is known to be small.
    """
    keys = drop.select("dataset_id", "user_id")
    return (catalog.join(keys, ["dataset_id", "user_id"], "left_anti"),
            reports.join(keys, ["dataset_id", "user_id"], "left_anti"))
