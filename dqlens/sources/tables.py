"""The driver's parquet tables and the fixtures Spark derives from them.

Fixtures are written as SQL expressions (``selectExpr``): one parse and one
analysis per step however many fields they derive.  Every fixture keeps
every row of the table it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dqlens.functions import constants as K
from dqlens.functions.expressions import sql_string

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {sql_string(k)} THEN {'NULL' if v is None else sql_string(v)}"
                     for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with injected defects (SURVEY Appendix A ``dirty``).

    Every orders row is kept; defects are chosen by arithmetic on the key:
    priority_txt has null / '' / spaces / 'NaN' text, price is null on exactly
    20 % of rows, cust_txt holds 'bad' words and blanks where a bigint is
    wanted, const_col is constant, empty_col is all null.
    """
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 11 = 0 THEN '' "
        "WHEN o_orderkey % 13 = 0 THEN '  ' WHEN o_orderkey % 17 = 0 THEN 'NaN' "
        "ELSE o_orderpriority END AS priority_txt",
        "CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice END AS price",
        "CASE WHEN o_orderkey % 19 = 0 THEN 'bad' WHEN o_orderkey % 23 = 0 THEN '' "
        "ELSE CAST(o_custkey AS STRING) END AS cust_txt",
        "'K' AS const_col",
        "CAST(NULL AS STRING) AS empty_col",
    )


# Wanted types for ``dirty`` when it is checked for badly typed values:
# cust_txt should hold customer keys.
DIRTY_WANTED = {"o_orderkey": "bigint", "priority_txt": "string", "price": "double",
                "cust_txt": "bigint", "const_col": "string", "empty_col": "string"}


# --------------------------------------------------------------------------
# catalogue stand-in: one dataset per order
# --------------------------------------------------------------------------

# fixed mapping of the stand-in: order priority -> dataset status
PRIORITY_STATUS = {
    "1-URGENT": "done",
    "2-HIGH": "analyzing",
    "3-MEDIUM": "uploading_hdfs",
    "4-NOT SPECIFIED": "failed",
    "5-LOW": "queued",
}

# custom names typed by the stand-in's users: whitespace only, or padded with
# an ideographic space and a newline (Python's strip removes both)
BLANK_CUSTOM_NAME = " \t "
CUSTOM_NAME_PAD_LEFT = "\u3000 "
CUSTOM_NAME_PAD_RIGHT = "\n"

LANDING_PATH_SQL = ("concat('/landing/', CAST(user_id AS STRING), '/', "
                    "CAST(dataset_id AS STRING), '/raw.csv')")


def _standin_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = ("CASE WHEN o_orderstatus = 'P' THEN 'archived' ELSE "
              + _case("o_orderpriority", PRIORITY_STATUS) + " END")
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS dataset_id",
        "o_custkey AS user_id",
        f"CASE WHEN o_orderstatus = 'F' THEN CAST(NULL AS STRING) "
        f"WHEN o_orderpriority = '5-LOW' THEN {sql_string(BLANK_CUSTOM_NAME)} "
        f"ELSE concat({sql_string(CUSTOM_NAME_PAD_LEFT)}, o_orderpriority, "
        f"{sql_string(CUSTOM_NAME_PAD_RIGHT)}) END AS custom_raw",
        "concat('orders_', CAST(o_orderkey AS STRING), '.csv') AS filename",
        f"{status} AS final_status",
        "o_orderdate AS created_at",
        "o_totalprice",
    )
    return base.selectExpr(
        "*", "CASE final_status WHEN 'queued' THEN 0 WHEN 'uploading_hdfs' THEN 1 "
             "WHEN 'analyzing' THEN 2 ELSE 3 END AS final_stage")


def _fields_at(stage: str) -> list[str]:
    """Catalogue fields *set* by the event of pipeline stage ``stage``
    (null = unset): 0 registers (queued), 1 starts the upload, 2 starts the
    analysis and records the landing path, 3 ends: done (counts), failed
    (message) or an unknown code."""
    return [
        f"CASE {stage} WHEN 0 THEN 'queued' WHEN 1 THEN 'uploading_hdfs' "
        f"WHEN 2 THEN 'analyzing' ELSE final_status END AS status",
        f"CASE WHEN {stage} = 0 THEN {sql_string(K.STEP_INITIAL_ANALYSIS)} END AS step",
        f"CASE WHEN {stage} = 0 THEN filename END AS filename",
        f"CASE WHEN {stage} = 0 THEN custom_raw END AS custom_raw",
        f"CASE WHEN {stage} = 0 THEN created_at END AS created_at",
        f"CASE WHEN {stage} = 2 THEN {LANDING_PATH_SQL} END AS hdfs_path",
        f"CASE WHEN {stage} = 3 AND final_status = 'done' "
        f"THEN CAST(FLOOR(o_totalprice) AS BIGINT) END AS row_count",
        f"CASE WHEN {stage} = 3 AND final_status = 'done' THEN CAST(9 AS BIGINT) END AS column_count",
        f"CASE WHEN {stage} = 3 AND final_status = 'failed' "
        f"THEN concat('cannot read ', filename) END AS error_message",
        f"created_at + make_dt_interval(0, 0, {stage}, 0) AS updated_at",
    ]


def catalog_events_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events of the stand-in catalogue: one per stage reached.

    Each order emits 1..4 events by a per-row ``explode(sequence(...))``.
    """
    ev = _standin_base(spark, sf_dir).selectExpr(
        "*", "explode(sequence(0, final_stage)) AS stage")
    return ev.selectExpr("dataset_id", "user_id", *_fields_at("stage"))


def catalog_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` read as a dataset catalogue (SURVEY Appendix A), current state.

    dataset_id = o_orderkey, user_id = o_custkey, created_at = o_orderdate.
    Status follows the order priority; orders in status 'P' carry a status
    code the catalogue does not know ('archived': progress 0, label as-is).
    Custom names exercise the whitespace rules of the display name.  The
    state equals the fold of ``catalog_events_standin`` (each field from the
    last stage that set it).
    """
    cat = _standin_base(spark, sf_dir).selectExpr(
        "dataset_id", "user_id", "custom_raw", "filename",
        "final_status AS status",
        f"{sql_string(K.STEP_INITIAL_ANALYSIS)} AS step",
        "CASE WHEN final_stage = 3 AND final_status = 'done' "
        "THEN CAST(FLOOR(o_totalprice) AS BIGINT) END AS row_count",
        "CASE WHEN final_stage = 3 AND final_status = 'done' THEN CAST(9 AS BIGINT) END AS column_count",
        f"CASE WHEN final_stage >= 2 THEN {LANDING_PATH_SQL} END AS hdfs_path",
        "CASE WHEN final_stage = 3 AND final_status = 'failed' "
        "THEN concat('cannot read ', filename) END AS error_message",
        "created_at",
        "created_at + make_dt_interval(0, 0, final_stage, 0) AS updated_at",
    )
    from dqlens.operators.catalog import with_names
    return with_names(cat).drop("custom_raw")


def reports_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the stand-in: datasets whose analysis is done."""
    return catalog_standin(spark, sf_dir).where("status = 'done'").selectExpr(
        "dataset_id", "user_id", "updated_at AS generated_at", "hdfs_path",
        "row_count AS report_rows", "column_count AS report_columns")


# fixed mapping of the stand-in: order priority -> declared MIME type of the
# upload, and order status -> file-name suffix
PRIORITY_MIME = {
    "1-URGENT": "text/csv",
    "2-HIGH": "application/json",
    "3-MEDIUM": "text/plain",
    "4-NOT SPECIFIED": None,
    "5-LOW": "application/vnd.ms-excel",
}
STATUS_SUFFIX = {"F": ".CSV", "O": ".csv.gz", "P": ".txt"}


def uploads_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload requests ``(dataset_id, filename, mime)`` derived from orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS dataset_id",
        "concat('orders_', CAST(o_orderkey AS STRING), "
        + _case("o_orderstatus", STATUS_SUFFIX) + ") AS filename",
        _case("o_orderpriority", PRIORITY_MIME, "CAST(NULL AS STRING)") + " AS mime",
    )
