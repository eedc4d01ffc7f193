"""Report folding over the long-form column profile.

All inputs here are per-column frames (C rows, bounded by the schema width),
so the single-group aggregations below never gather data rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.functions import constants as K
from dqlens.functions.expressions import col, pct1, quote, suggestion_texts
from dqlens.operators.profile import NAME, POSITION


def _heavy(frame: DataFrame):
    ratio = F.try_divide(F.col("n_missing").cast("double"), F.col("row_count").cast("double"))
    return (F.col("row_count") > 0) & (ratio > F.lit(K.HEAVY_MISSING_RATIO))


def missing_pct(stats: DataFrame) -> DataFrame:
    """Columns with missing values and their share, one decimal, half up."""
    return (stats.where(F.col("n_missing") > 0)
            .select(POSITION, NAME, "n_missing",
                    pct1(F.col("n_missing"), F.col("row_count")).alias("pct")))


def missing_summary(stats: DataFrame) -> DataFrame:
    """One row: total missing cells and number of columns having any."""
    has = F.col("n_missing") > 0
    return stats.agg(
        F.coalesce(F.sum(F.when(has, F.col("n_missing"))), F.lit(0)).cast("bigint").alias("total_missing"),
        F.count_if(has).cast("bigint").alias("columns_with_missing"),
    )


def heavy_missing(stats: DataFrame) -> DataFrame:
    """Columns whose missing share is strictly above 20 %."""
    return stats.where(_heavy(stats)).select(POSITION, NAME)


def _ordered_names(cond) -> F.Column:
    picked = F.collect_list(F.when(cond, F.struct(F.col(POSITION), F.col(NAME))))
    return F.transform(F.sort_array(picked), lambda x: x[NAME])


def suggestions(stats: DataFrame) -> DataFrame:
    """The cleaning suggestions as rows ``(suggestion_no, suggestion)``."""
    texts = stats.agg(
        suggestion_texts(_ordered_names(F.col("n_distinct") <= 1),
                         _ordered_names(_heavy(stats))).alias("s"))
    return texts.select(F.posexplode("s").alias("suggestion_no", "suggestion")).select(
        (F.col("suggestion_no") + 1).alias("suggestion_no"), "suggestion")


REPORT_SCHEMA_DDL = (
    "row_count bigint, column_count bigint, "
    "schema array<struct<name:string,dtype:string>>, "
    "null_counts map<string,bigint>, bad_type_counts map<string,bigint>, "
    "distinct_counts map<string,bigint>, constant_columns array<string>, "
    "suggestions array<string>"
)


def stored_report_schema() -> T.StructType:
    """Schema of the stored reports table (partition columns last)."""
    return T._parse_datatype_string(
        "generated_at timestamp_ntz, hdfs_path string, " + REPORT_SCHEMA_DDL
        + ", user_id string, dataset_id string")


def report_document(profile: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fold the long-form profile (with ``n_bad``) into one nested row
    (per value of ``keys`` when given: one report per dataset).

    Shape of the reference's report: row_count, column_count, schema
    [{name, dtype}], null_counts {col: n}, bad_type_counts {col: n} (non-zero
    only), distinct_counts {col: n}, constant_columns [..], suggestions [..];
    maps and lists in schema order.
    """
    # a repeated column name keeps its last value, as a dict would
    same_name = Window.partitionBy(*(keys or []), NAME)
    profile = profile.withColumn("_last", F.col(POSITION) == F.max(POSITION).over(same_name))
    last = F.col("_last")

    def entries(value_col: str, cond=None):
        item = F.struct(F.col(POSITION), F.col(NAME), F.col(value_col).alias("v"))
        picked = F.collect_list(F.when(last if cond is None else last & cond, item))
        return F.map_from_entries(F.transform(F.sort_array(picked), lambda x: F.struct(x[NAME], x["v"])))

    schema_list = F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(POSITION), F.col(NAME), F.col("dtype")))),
        lambda x: F.struct(x[NAME].alias("name"), x["dtype"].alias("dtype")))
    constant = _ordered_names(F.col("n_distinct") <= 1)
    heavy = _ordered_names(_heavy(profile))
    grouped = profile.groupBy(*keys) if keys else profile
    return grouped.agg(
        F.coalesce(F.max("row_count"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).cast("bigint").alias("column_count"),
        schema_list.alias("schema"),
        entries("n_missing").alias("null_counts"),
        entries("n_bad", F.col("n_bad") > 0).alias("bad_type_counts"),
        entries("n_distinct").alias("distinct_counts"),
        constant.alias("constant_columns"),
        suggestion_texts(constant, heavy).alias("suggestions"),
    )


def empty_reports(spark, owners: list[tuple[str, str]]) -> DataFrame:
    """Reports of tables without columns (empty CSV files), one per
    ``(user_id, dataset_id)``."""
    return spark.createDataFrame([(u, d, 0, 0, [], {}, {}, {}, [], []) for u, d in owners],
                                 "user_id string, dataset_id string, " + REPORT_SCHEMA_DDL)


# --------------------------------------------------------------------------
# stored reports of any shape
# --------------------------------------------------------------------------

#: texts that count as numbers, blanks around them taken off
NUMBER_TEXT = r"^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"


def _number_sql(v: str) -> str:
    """SQL text: a JSON value as a number, null if it is none.  Numbers and texts
    of numbers count, true is 1, and false, JSON null and blank text are 0;
    other texts, lists and objects are no numbers."""
    text = f"trim(try_variant_get({v}, '$', 'string'))"
    return (f"CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN 0D"
            f" WHEN schema_of_variant({v}) = 'BOOLEAN' THEN if(try_variant_get({v}, '$', 'boolean'), 1D, 0D)"
            f" WHEN schema_of_variant({v}) = 'STRING' THEN if({text} = '', 0D, if({text} RLIKE '{NUMBER_TEXT}', try_cast({text} AS double), NULL))"
            f" WHEN schema_of_variant({v}) RLIKE '^(ARRAY|OBJECT)' THEN NULL"
            f" ELSE try_variant_get({v}, '$', 'double') END")


def numbers_of(doc: str, name: str) -> F.Column:
    """P16: field ``name`` of a variant column as map<string,double>: entries that
    are no numbers are dropped, and what is no object has no entries."""
    entries = f"try_variant_get({doc}, '$.{name}', 'map<string,variant>')"
    return F.expr(f"coalesce(map_filter(transform_values({entries}, (k, v) -> {_number_sql('v')}),"
                  " (k, n) -> n IS NOT NULL), cast(map() AS map<string,double>))")


def texts_of(doc: str, name: str) -> F.Column:
    """P17: field ``name`` of a variant column as array<string>: null or absent is
    the empty list, a single value a list of one; null in a list is the text
    ``null``, nested values are their JSON."""
    value, text = f"variant_get({doc}, '$.{name}', 'variant')", "coalesce(try_variant_get(x, '$', 'string'), to_json(x), 'null')"
    many = f"try_variant_get({doc}, '$.{name}', 'array<variant>')"
    return F.expr(f"CASE WHEN {value} IS NULL OR is_variant_null({value}) THEN cast(array() AS array<string>)"
                  f" ELSE transform(coalesce({many}, array({value})), x -> {text}) END")


def tolerant_reports(frame: DataFrame, text_col: str) -> DataFrame:
    """Reports stored as JSON text, whatever their shape: the columns of ``frame``
    and ``row_count`` (double, 0 if it is no number), ``null_counts``,
    ``bad_type_counts``, ``distinct_counts``, ``constant_columns``,
    ``suggestions``.  Text that is no JSON is an empty report."""
    doc = "__dqlens_doc"
    parsed = frame.withColumn(doc, F.expr(f"try_parse_json({quote(text_col)})"))
    rows = f"try_variant_get({doc}, '$.row_count', 'variant')"
    return parsed.select(
        *[col(c) for c in frame.columns], F.expr(f"coalesce({_number_sql(rows)}, 0D)").alias("row_count"),
        *[numbers_of(doc, n).alias(n) for n in ("null_counts", "bad_type_counts", "distinct_counts")],
        *[texts_of(doc, n).alias(n) for n in ("constant_columns", "suggestions")])
