"""CSV scans, physical line counts and file listings.

Defaults follow the reference exactly: ``header`` on, schema inferred by a
full pass, every other option at Spark's default.  Dialect options
(``multiLine``, ``escape``, ``samplingRatio`` ...) pass through ``**options``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.functions.expressions import is_csv_file
from dqlens.session import session_conf


#: options that change how the reader parses values, not which cells there are
PARSING_OPTIONS = {"dateformat", "timestampformat", "timestampntzformat", "locale", "nanvalue", "positiveinf",
                   "negativeinf", "enabledatetimeparsingfallback", "mode", "columnnameofcorruptrecord"}


def default_parsing(options) -> bool:
    """The reader parses values as a cast would."""
    return not PARSING_OPTIONS & {o.lower() for o in options}


def read_typed(spark: SparkSession, path: str, timestamp_ntz: bool = False,
               schema=None, **options) -> DataFrame:
    """Typed scan: header row, schema inferred from the whole file.

    ``timestamp_ntz=True`` infers zone-less timestamps as TIMESTAMP_NTZ
    (wall-clock values, independent of the session time zone; a local-time
    ``timestamp`` shifts values that fall in a daylight-saving gap).  The
    default keeps Spark's inference (``timestamp``), as the original does.
    ``schema`` (a StructType or DDL string) skips the inference pass -- one
    full read less when the layout is known.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    if not timestamp_ntz:
        return reader.csv(path)
    with session_conf(spark, "spark.sql.timestampType", "TIMESTAMP_NTZ"):
        return reader.csv(path)   # the schema is inferred here, eagerly


# --------------------------------------------------------------------------
# inference of many files in one job
# --------------------------------------------------------------------------

# what a value can be read as, one bit each; OTHER is left to Spark's own inference
INT, LONG, DOUBLE, DATE, TIMESTAMP, BOOLEAN, STRING, OTHER = (1 << k for k in range(8))


def value_kind(v: Column) -> Column:
    """The narrowest kind of a CSV value, in the order in which the reader's
    inference tries them (0 for null).  Whole numbers beyond bigint and digits
    of other scripts are ``OTHER``: rare, and their types depend on their neighbours."""
    special = v.isin("NaN", "Inf", "-Inf", "Infinity", "+Infinity", "-Infinity") | ~v.rlike("(?i)nan|inf")
    whole = F.when(v.try_cast("int").isNotNull(), INT).when(v.try_cast("bigint").isNotNull(), LONG).otherwise(OTHER)
    return (F.when(v.isNull(), 0).when(v.rlike("^[+-]?[0-9]+$"), whole)
            .when(v.rlike("^[+-]?[0-9]+[.]$") | v.rlike(r"[\p{Nd}&&[^0-9]]"), OTHER)
            .when(v.try_cast("double").isNotNull() & special, DOUBLE)
            .when(v.rlike("^-?[0-9]{4}-[0-9]{2}-[0-9]{2}$") & v.try_cast("date").isNotNull(), DATE)
            .when(v.try_cast("timestamp").isNotNull(), TIMESTAMP)
            .when(F.lower(v).isin("true", "false"), BOOLEAN).otherwise(STRING))


#: the kinds that a type holds, narrowest first
KIND_TYPES = ((INT, T.IntegerType()), (INT | LONG, T.LongType()), (INT | LONG | DOUBLE, T.DoubleType()),
              (DATE, T.DateType()), (DATE | TIMESTAMP, T.TimestampType()), (BOOLEAN, T.BooleanType()))


def column_type(kinds: int) -> T.DataType | None:
    """The type that holds all kinds of a column; None leaves it to Spark."""
    if kinds & OTHER:
        return None
    for held, dtype in KIND_TYPES:
        if kinds and not kinds & ~held:
            return dtype
    return T.StringType()


def safe_names(cells: list[str | None]) -> list[str]:
    """Column names of a header as the reader makes them: empty ones are
    ``_c<i>``, repeated ones (whatever their case) get their position."""
    lower = [c.lower() for c in cells if c]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def infer_many(spark: SparkSession, places: dict[str, str], headers: dict[str, str]) -> dict[str, T.StructType]:
    """Schemas of many CSV files of the default dialect, in one job: id ->
    schema.  ``places``: id -> path as the reader spells it; ``headers``: id ->
    first line.

    All of them are one scan of strings, as wide as the widest header; a value's kind is
    found where it is read, and what crosses the shuffle is one bit set per task,
    file and column.  Files that need Spark's own inference (``value_kind``, or
    quotes or a byte order mark in the header) have no entry in the result.  A data
    line that repeats the header counts as data."""
    headers = {d: h for d, h in headers.items() if d in places and '"' not in h and not h.startswith("\ufeff")}
    if not headers or spark.conf.get("spark.sql.timestampType") != "TIMESTAMP_LTZ":
        return {}
    cells = {d: [c or None for c in h.rstrip("\r").split(",")] for d, h in headers.items()}
    width = max(map(len, cells.values()))
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).option("header", True).csv(
        list(dict.fromkeys(places[d] for d in headers)))
    # one row per file: about as much as the reader's listing
    found = raw.withColumn("_file", F.col("_metadata.file_path")).groupBy("_file").agg(
        *[F.bit_or(value_kind(F.col(f"c{i}"))).alias(f"k{i}") for i in range(width)]).collect()
    plain = lambda path: re.sub("^file:/+", "file:/", path)
    kinds = {plain(r["_file"]): [r[f"k{i}"] or 0 for i in range(width)] for r in found}
    out = {}
    for d, names in cells.items():
        types = [column_type(k) for k in kinds.get(plain(places[d]), [0] * width)[:len(names)]]
        if None not in types:
            out[d] = T.StructType([T.StructField(n, t) for n, t in zip(safe_names(names), types)])
    return out


def read_raw(spark: SparkSession, path: str, **options) -> DataFrame:
    """Raw scan of the same file: every column a string, no inference pass."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, **options) -> str:
    """Write ``df`` as CSV with a header; timestamps keep microseconds."""
    writer = (df.write.mode("overwrite").option("header", True)
              .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
              .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.csv(path)
    return path


def lines_per_file(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines of every file below ``path``: ``(path, n_lines)``.

    A line is a run of bytes ended by ``\\n``, plus a last one without it; an
    empty file has none.  Reading with ``lineSep='\\n'`` gives exactly that
    (the default separator also splits on a lone ``\\r``).  Files are split
    across tasks by Spark; only the file-path metadata column is read, and
    counts are summed per file by one small shuffle (one partial row per task
    and file, so a file holding most of the lines is no hot spot).
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return (lines.select(F.col("_metadata.file_path").alias("path"))
            .groupBy("path").agg(F.count(F.lit(1)).alias("n_lines")))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """Total physical lines below ``path``: one row ``line_count``."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.agg(F.count(F.lit(1)).alias("line_count"))


def row_limit_gate(spark: SparkSession, path: str, max_rows: int) -> DataFrame:
    """Upload gate: data lines (physical lines minus one header per file).

    One row ``(n_files, n_lines, n_rows, max_rows, accepted)``; rejected when
    ``n_rows > max_rows``.  Blank lines and quoted newlines count, as in the
    reference.  ``max_rows`` has no default: a limit is the caller's choice.
    """
    per_file = lines_per_file(spark, path)
    return per_file.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_files"),
        F.coalesce(F.sum("n_lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.sum(F.greatest(F.col("n_lines") - 1, F.lit(0))), F.lit(0)).cast("bigint").alias("n_rows"),
    ).select("n_files", "n_lines", "n_rows",
             F.lit(max_rows).cast("bigint").alias("max_rows"),
             (F.col("n_rows") <= F.lit(max_rows)).alias("accepted"))


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Listing of the files below ``path``: ``(path, name, length, modified)``.

    ``binaryFile`` without the ``content`` column reads no file bytes; the
    listing itself is distributed by Spark's file index.
    """
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    files = reader.load(path).select("path", "length", "modificationTime")
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def accept_files(files: DataFrame, name_col: str = "name", mime_col: str | None = None) -> DataFrame:
    """Adds ``accepted``: MIME in the allowed set or a ``.csv`` name."""
    mime = F.col(mime_col) if mime_col else None
    return files.withColumn("accepted", is_csv_file(F.col(name_col), mime))
