"""One-pass column profile of any DataFrame.

The naive form of this profile runs 3C+1 Spark actions for C columns (one
count, then one job per column for missing values, distinct values and badly
typed values), each re-reading the input.  Here:

* ``column_stats`` computes row count, missing count, exact distinct count
  and the constant flag of *every* column with one scan and one shuffle.  Each
  row is turned into C ``(position, value)`` records (``inline`` of an array of
  structs -- a codegen'd Generate, no UDF).  Values keep their own type in a
  slot per *data type* (not per column), so the record width grows with the
  number of distinct types, not with C.  ``groupBy(position, slots)`` then
  yields one row per distinct value with its frequency; partial aggregation
  collapses hot values map-side, so a value holding a third of all rows
  crosses the shuffle once per map task.  Long texts travel as two hashes and
  their length (``text_key``).  "Missing" and "wrongly typed" are flags of the
  value, set where it is read.
* ``missing_counts`` / ``row_count`` need no shuffle at all: one ``agg`` with a
  ``count_if`` per column (partial aggregation, one row per task).
* ``bad_type_counts`` is one ``agg`` over the raw string scan, restricted to
  the columns whose wanted type differs from the raw type (a cast to string
  never fails), so string-only tables cost no job.  When the raw values are
  the profiled frame itself, ``profile_columns`` counts them in the same job
  instead; a CSV whose types are known is one scan of strings, converted
  where they are read (``profile_strings``).
* ``column_stats_many`` profiles frames of different schemas in one job by
  giving them one common long form.

Every per-column result is long form ``(position, column_name, ...)``: C rows,
bounded by the schema width, never by the data.
"""

from __future__ import annotations

import contextlib
import datetime as _dt
import io
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.functions import constants as K
from dqlens.functions.expressions import bad_value, missing_sql, quote, sql_string

POSITION = "position"
NAME = "column_name"

STATS_SCHEMA = T.StructType([
    T.StructField(POSITION, T.IntegerType(), False),
    T.StructField(NAME, T.StringType(), False),
    T.StructField("dtype", T.StringType(), False),
    T.StructField("row_count", T.LongType(), False),
    T.StructField("n_missing", T.LongType(), False),
    T.StructField("n_distinct", T.LongType(), False),
])

MISSING_SCHEMA = T.StructType([
    T.StructField(POSITION, T.IntegerType(), False),
    T.StructField(NAME, T.StringType(), False),
    T.StructField("n_missing", T.LongType(), False),
])

BAD_SCHEMA = T.StructType([
    T.StructField(POSITION, T.IntegerType(), False),
    T.StructField(NAME, T.StringType(), False),
    T.StructField("n_bad", T.LongType(), False),
])


# --------------------------------------------------------------------------
# metadata
# --------------------------------------------------------------------------

def schema_rows(df: DataFrame) -> list[tuple[int, str, str]]:
    """``(position, name, simpleString)`` per field: driver metadata only."""
    return [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, _dt.datetime):
        return f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'"
    if isinstance(v, _dt.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return sql_string(str(v))


def literal_frame(spark, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small literal table built JVM-side (no Python RDD) with one
    expression: used for per-column metadata, whose size is the schema width.
    Values are ints, floats, strings, booleans, datetimes or None."""
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name)
                                       for f in schema.fields])
    structs = ["named_struct(" + ", ".join(f"{sql_string(f.name)}, {_sql_literal(v)}"
                                           for v, f in zip(r, schema.fields)) + ")"
               for r in rows]
    casts = [f"CAST({quote(f.name)} AS {f.dataType.simpleString()}) AS {quote(f.name)}"
             for f in schema.fields]
    return (spark.range(0, 1, 1, 1).selectExpr("inline(array(" + ", ".join(structs) + "))")
            .selectExpr(*casts))


SCHEMA_REPORT_SCHEMA = T.StructType([
    T.StructField(POSITION, T.IntegerType(), False),
    T.StructField(NAME, T.StringType(), False),
    T.StructField("dtype", T.StringType(), False),
])


def schema_report(df: DataFrame) -> DataFrame:
    """The schema as rows ``(position, column_name, dtype)``."""
    return literal_frame(df.sparkSession, schema_rows(df), SCHEMA_REPORT_SCHEMA)


def _unpivot_one_row(row: DataFrame, items: list[tuple[int, str, str]],
                     value_name: str) -> DataFrame:
    """Turn a one-row, C-column aggregate into C rows (position, name, value)."""
    structs = [f"named_struct('{POSITION}', {pos}, '{NAME}', {sql_string(name)}, "
               f"'{value_name}', CAST({alias} AS BIGINT))" for pos, name, alias in items]
    return row.selectExpr("inline(array(" + ", ".join(structs) + "))")


# --------------------------------------------------------------------------
# shuffle-free counters
# --------------------------------------------------------------------------

def row_count(df: DataFrame) -> DataFrame:
    """One row ``row_count`` (logical records)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def positional(df: DataFrame) -> DataFrame:
    """The same frame with columns named ``c0..c{n-1}`` (one call): names
    repeated by a join, or holding dots and backticks, become unambiguous."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def missing_counts(df: DataFrame) -> DataFrame:
    """``(position, column_name, n_missing)`` for every column, one pass.

    String columns count null, blank and ``nan`` text; other types count null.
    """
    fields = df.schema.fields
    if not fields:
        return literal_frame(df.sparkSession, [], MISSING_SCHEMA)
    row = positional(df).agg(*[F.expr(f"count_if({missing_sql(f'c{i}', f.dataType)}) AS m{i}")
                               for i, f in enumerate(fields)])
    return _unpivot_one_row(row, [(i, f.name, f"m{i}") for i, f in enumerate(fields)], "n_missing")


def _wanted_fields(schema: T.StructType, wanted) -> list[tuple[int, str, T.DataType]]:
    if wanted is None:
        return [(i, f.name, f.dataType) for i, f in enumerate(schema.fields)]
    if isinstance(wanted, T.StructType):
        return [(i, f.name, f.dataType) for i, f in enumerate(wanted.fields)]
    if isinstance(wanted, Mapping):
        return [(i, n, T._parse_datatype_string(t) if isinstance(t, str) else t)
                for i, (n, t) in enumerate(wanted.items())]
    raise TypeError("wanted must be a StructType or a mapping name -> type")


def bad_type_counts(raw: DataFrame, wanted=None, keep_zero: bool = False) -> DataFrame:
    """Values that are non-blank in ``raw`` but do not convert to the wanted type.

    ``raw`` is usually the all-string scan of a file; ``wanted`` a StructType
    (default: raw's own schema, which yields nothing) or a mapping
    name -> type.  Output ``(position, column_name, n_bad)``, positions taken
    from ``wanted``; zero rows are dropped unless ``keep_zero``.
    """
    wanted_list = _wanted_fields(raw.schema, wanted)
    raw_fields = raw.schema.fields
    if [n for _, n, _ in wanted_list] == [f.name for f in raw_fields]:
        # same columns in the same order (typed vs raw scan of one file):
        # pair by position, so repeated names are no problem
        pairs = [(pos, name, t, pos, raw_fields[pos].dataType) for pos, name, t in wanted_list]
    else:
        index = {f.name: i for i, f in enumerate(raw_fields)}
        if absent := [name for _, name, _ in wanted_list if name not in index]:
            raise ValueError(f"no such column to check: {', '.join(absent)}")
        pairs = [(pos, name, t, index[name], raw_fields[index[name]].dataType)
                 for pos, name, t in wanted_list]
    checks = [(pos, name, t, rpos) for pos, name, t, rpos, rt in pairs
              if not isinstance(t, T.StringType) and rt != t]
    spark = raw.sparkSession
    if not checks:
        if keep_zero:
            rows = [(pos, name, 0) for pos, name, _ in wanted_list]
            return literal_frame(spark, rows, BAD_SCHEMA)
        return literal_frame(spark, [], BAD_SCHEMA)
    aggs = [F.count_if(bad_value(F.col(f"c{rpos}"), t)).alias(f"b{j}")
            for j, (_, _, t, rpos) in enumerate(checks)]
    row = positional(raw).agg(*aggs)
    out = _unpivot_one_row(row, [(pos, name, f"b{j}") for j, (pos, name, _, _) in enumerate(checks)], "n_bad")
    if keep_zero:
        checked = {pos for pos, _, _, _ in checks}
        rest = [(pos, name, 0) for pos, name, _ in wanted_list if pos not in checked]
        if rest:
            out = out.unionByName(literal_frame(spark, rest, BAD_SCHEMA))
        return out
    return out.where(F.col("n_bad") > 0)


# --------------------------------------------------------------------------
# value-frequency long form: distinct + missing + rows in one shuffle
# --------------------------------------------------------------------------

def physical_plan(df: DataFrame) -> str:
    """The physical plan text, from ``explain`` (plans, runs nothing)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


# texts up to this many bytes are compared as they are
LONGEST_TEXT_KEY = 48


def hashed_text(value: str) -> str:
    """SQL text of whether ``text_key`` stands for a string by its hashes."""
    return f"(octet_length({value}) > {LONGEST_TEXT_KEY} OR startswith({value}, '\\u0000'))"


def text_key(value: str, first: str = "xxhash64({0})") -> str:
    """SQL text of what stands for a string in the value shuffle.

    Short strings stand for themselves.  A longer one is replaced by two
    independent 64-bit hashes and its length in bytes, so that whole texts do
    not travel: equal texts have equal keys, and two texts that differ share
    a key only if both hashes and the length agree (2^-128 a pair).  Keys of
    hashed texts begin with NUL, and so are strings hashed that begin with NUL:
    a text is never taken for a key."""
    hashed = ", ".join(f"lpad(hex({h.format(value)}), 16, '0')" for h in (first, "xxhash64(1, {0})"))
    return (f"if({hashed_text(value)}, "
            f"concat('\\u0000', {hashed}, hex(octet_length({value}))), {value})")


def _slot_sql(value: str, dtype: T.DataType) -> str:
    """SQL text of the groupable form of a value (maps: sorted entries)."""
    if isinstance(dtype, T.MapType):
        return f"array_sort(map_entries({value}))"
    if dtype == T.StringType():            # without a collation of its own
        return text_key(value)
    return value


def _groupable_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.MapType):
        return T.ArrayType(T.StructType([T.StructField("key", dtype.keyType, False),
                                         T.StructField("value", dtype.valueType, True)]), False)
    return dtype


def _slots_of(fields: list[T.StructField]) -> list[T.DataType]:
    """One value slot per distinct groupable data type, in order of first use."""
    slot_types: list[T.DataType] = []
    for f in fields:
        t = _groupable_type(f.dataType)
        if t not in slot_types:
            slot_types.append(t)
    return slot_types


def _slot_layout(frames: list[DataFrame]) -> list[T.DataType]:
    return _slots_of([f for df in frames for f in df.schema.fields])


@dataclass(frozen=True)
class Profiled:
    """One column of a long form: SQL texts of its value and of the predicates
    "missing" and "wrongly typed"."""
    value: str
    dtype: T.DataType
    missing: str
    bad: str | None = None


FLAGS = "flags"      # of a value: 1 missing, 2 wrongly typed, 3 both


def bad_sql(raw: str, wanted: T.DataType) -> str:
    """SQL text of ``expressions.bad_value``."""
    return f"(length(trim({raw})) > 0 AND try_cast({raw} AS {wanted.simpleString()}) IS NULL)"


def _expand(src: DataFrame, columns: list[Profiled], slot_types: list[T.DataType],
            keys: list[str] = ()) -> DataFrame:
    """Each row -> one ``(*keys, position, flags, s0..sk)`` record per column.

    The expansion is one SQL expression (one call into the JVM however wide
    the table is).  A slot a column does not use holds ``if(false, x, null)``
    with ``x`` a value of the slot's type -- a typed null the optimizer
    folds to a literal; slot types of no column get a typed null column.
    Rows stay where the reader put them.  ``keys`` are columns of ``src``.
    """
    exprs = [_slot_sql(c.value, c.dtype) for c in columns]
    slot_of = [slot_types.index(_groupable_type(c.dtype)) for c in columns]
    rep: dict[int, str] = {}
    for e, j in zip(exprs, slot_of):
        rep.setdefault(j, e)
    absent = [j for j in range(len(slot_types)) if j not in rep]
    if absent:
        src = src.withColumns({f"__dqlens_null{j}": F.lit(None).cast(slot_types[j]) for j in absent})
        rep.update({j: quote(f"__dqlens_null{j}") for j in absent})
    nulls = {j: f"if(false, {r}, null)" for j, r in rep.items()}
    head = [f"'{k}', {quote(k)}" for k in keys]
    structs = []
    for i, (c, e) in enumerate(zip(columns, exprs)):
        flags = f"if({c.missing}, 1, 0)" + (f" + if({c.bad}, 2, 0)" if c.bad else "")
        members = head + [f"'{POSITION}', {i}", f"'{FLAGS}', cast({flags} AS tinyint)"]
        members += [f"'s{j}', {e if slot_of[i] == j else nulls[j]}" for j in range(len(slot_types))]
        structs.append("named_struct(" + ", ".join(members) + ")")
    return src.select(F.expr("inline(array(" + ", ".join(structs) + "))"))


def _own_columns(fields: list[T.StructField], checks: Mapping[int, T.DataType] = {}) -> list[Profiled]:
    """The columns ``c0..`` of a positional frame as they are; ``checks``:
    position -> type to check the values against."""
    return [Profiled(f"c{i}", f.dataType, missing_sql(f"c{i}", f.dataType),
                     bad_sql(f"c{i}", checks[i]) if i in checks else None) for i, f in enumerate(fields)]


def _converted(raw: DataFrame, schema: T.StructType, wanted: list[T.DataType], n: int) -> tuple[DataFrame, list[Profiled]]:
    """Columns ``c0..`` of strings read as the types of ``schema`` and checked
    against ``wanted``: every value is converted once, where it is read."""
    typed = [(i, f.dataType) for i, f in enumerate(schema.fields) if not isinstance(f.dataType, T.StringType)]
    src = raw.select("*", *[F.expr(f"try_cast(c{i} AS {t.simpleString()}) AS v{i}") for i, t in typed])
    columns = []
    for i, (f, want) in enumerate(zip(schema.fields, wanted)):
        value = f"c{i}" if isinstance(f.dataType, T.StringType) else f"v{i}"
        if isinstance(want, T.StringType):
            bad = None
        elif want == f.dataType:
            bad = f"(length(trim(c{i})) > 0 AND v{i} IS NULL)"
        else:
            bad = bad_sql(f"c{i}", want)
        columns.append(Profiled(value, f.dataType, missing_sql(value, f.dataType), bad))
    return src, columns


def _counted(long: DataFrame, slot_types: list[T.DataType], keys: list[str] = ()) -> DataFrame:
    slots = [f"s{j}" for j in range(len(slot_types))]
    return long.groupBy(*keys, POSITION, FLAGS, *slots).agg(F.count(F.lit(1)).alias("cnt"))


def value_counts(df: DataFrame, checks: Mapping[int, T.DataType] | None = None) -> tuple[DataFrame, list[T.DataType]]:
    """Per column, every distinct value (null included) with its frequency.

    Returns ``(frame, slot_types)``; the frame has columns
    ``position, flags, s0..s{k-1}, cnt`` where slot ``s{j}`` holds the values
    (long texts: their keys) of columns whose (groupable) type is
    ``slot_types[j]``.
    """
    slot_types = _slot_layout([df])
    long = _expand(positional(df), _own_columns(df.schema.fields, checks or {}), slot_types)
    return _counted(long, slot_types), slot_types


def _merged(counted: DataFrame, keys: list[str], slot_types: list[T.DataType]) -> DataFrame:
    """Per (keys, position): distinct values, rows, missing and wrongly typed
    ones.  Null is one value, also where some nulls are text that does not convert."""
    null = "(" + " AND ".join(f"s{j} IS NULL" for j in range(len(slot_types))) + ")"
    return counted.groupBy(*keys, POSITION).agg(
        F.expr(f"count_if(NOT {null}) + max(if({null}, 1, 0)) AS n_distinct"),
        F.expr("sum(cnt) AS n_rows"),
        F.expr(f"sum(if({FLAGS} & 1 > 0, cnt, 0)) AS n_miss"),
        F.expr(f"sum(if({FLAGS} & 2 > 0, cnt, 0)) AS n_bad"))


def _meta_frame(df: DataFrame) -> DataFrame:
    return literal_frame(df.sparkSession, schema_rows(df), SCHEMA_REPORT_SCHEMA)


def column_stats(df: DataFrame, exact: bool = True,
                 bad_checks: Mapping[int, T.DataType] | None = None) -> DataFrame:
    """``(position, column_name, dtype, row_count, n_missing, n_distinct)``.

    ``exact=True`` (default, the reference's semantics): one scan, one
    shuffle of distinct values.  Null counts as one distinct value, NaN equals
    NaN and 0.0 equals -0.0.  ``exact=False`` is an opt-in HyperLogLog++
    estimate (``approx_count_distinct``, plus one for null) computed without
    shuffling values -- for profiling 100 TB tables interactively.

    ``bad_checks`` (exact mode, atomic columns and wanted types): position
    -> wanted type.  A badly typed value is a property of the value, so it is
    counted on the distinct-value table of the same job (extra column
    ``n_bad``) instead of by a second scan.
    """
    fields = df.schema.fields
    spark = df.sparkSession
    if not fields:
        return literal_frame(spark, [], STATS_SCHEMA)
    meta = _meta_frame(df)
    extra = []
    if exact:
        counted, slot_types = value_counts(df, bad_checks)
        per_col = _merged(counted, [], slot_types)
        if bad_checks:
            extra = [F.coalesce(F.col("n_bad"), F.lit(0)).cast("bigint").alias("n_bad")]
    else:
        per_col = _estimates(positional(df), _own_columns(fields), [])
    # both sides hold at most C rows (one per column): broadcasting is bounded
    # by the schema width, never by the data.
    joined = meta.join(F.broadcast(per_col), POSITION, "left")
    return joined.select(
        F.col(POSITION), F.col(NAME), F.col("dtype"),
        F.coalesce(F.col("n_rows"), F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce(F.col("n_miss"), F.lit(0)).cast("bigint").alias("n_missing"),
        F.coalesce(F.col("n_distinct"), F.lit(0)).cast("bigint").alias("n_distinct"),
        *extra,
    )


def keyed_stats(df: DataFrame, key: str) -> DataFrame:
    """``(key, position, n_distinct, n_rows, n_miss, n_bad)`` of the columns of
    many datasets of one schema that share a frame; ``key`` is its last column.
    Datasets without rows have no result rows."""
    fields = df.schema.fields[:-1]
    slot_types = _slots_of(fields)
    src = df.toDF(*[f"c{i}" for i in range(len(fields))], key)
    return _merged(_counted(_expand(src, _own_columns(fields), slot_types, [key]), slot_types, [key]), [key], slot_types)


def string_stats(raw: DataFrame, schema: T.StructType, wanted: list[T.DataType], key: str | None = None,
                 exact: bool = True) -> DataFrame:
    """``([key,] position, n_distinct, n_rows, n_miss, n_bad)`` of a scan of
    strings read as ``schema`` and checked against ``wanted``: one scan and one
    value shuffle for all of it (none with ``exact=False``).  ``key`` is the last
    column, if given; datasets without rows have no result rows."""
    n = len(schema.fields)
    keys = [key] if key else []
    src, columns = _converted(raw.toDF(*[f"c{i}" for i in range(n)], *keys), schema, wanted, n)
    if not exact:
        return _estimates(src, columns, keys)
    slot_types = _slots_of(schema.fields)
    return _merged(_counted(_expand(src, columns, slot_types, keys), slot_types, keys), keys, slot_types)


def profile_strings(raw: DataFrame, schema: T.StructType, wanted=None, exact: bool = True) -> DataFrame:
    """``profile_columns`` of a raw scan whose types are known, in one scan.

    A value is converted by ``try_cast`` where the CSV reader would parse it.  On
    a schema inferred from the same file the two agree.  On a declared one they
    may not: a cast forgives spaces around numbers and reads more spellings of
    booleans, dates and timestamps, so such values count as present where the
    reader would have made them null."""
    fields = schema.fields
    meta = literal_frame(raw.sparkSession, [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
                         SCHEMA_REPORT_SCHEMA)
    if not fields:
        return profile_columns(raw)
    types = [f.dataType for f in fields] if wanted is None else _aligned_wanted(schema, wanted)
    out = meta.join(F.broadcast(string_stats(raw, schema, types, exact=exact)), POSITION, "left")     # C rows
    return out.select(POSITION, NAME, "dtype", *_counts(), (F.coalesce("n_distinct", F.lit(0)) <= 1).alias("is_constant"),
                      F.coalesce("n_bad", F.lit(0)).cast("bigint").alias("n_bad"))


def _estimates(src: DataFrame, columns: list[Profiled], keys: list[str]) -> DataFrame:
    """What ``_merged`` gives, with estimated distinct counts and no value shuffle."""
    aggs = [F.expr("count(1) AS n_rows")]
    structs = []
    for i, c in enumerate(columns):
        value = f"array_sort(map_entries({c.value}))" if isinstance(c.dtype, T.MapType) else c.value
        aggs += [F.expr(f"count_if({c.missing}) AS m{i}"), F.expr(f"count_if({c.bad or 'false'}) AS b{i}"),
                 F.expr(f"approx_count_distinct({value}) + coalesce(max(if({c.value} IS NULL, 1, 0)), 0) AS d{i}")]
        structs.append(f"named_struct('{POSITION}', {i}, 'n_distinct', CAST(d{i} AS BIGINT), 'n_rows', n_rows, "
                       f"'n_miss', CAST(m{i} AS BIGINT), 'n_bad', CAST(b{i} AS BIGINT))")
    row = src.groupBy(*keys).agg(*aggs) if keys else src.agg(*aggs)
    return row.selectExpr(*[quote(k) for k in keys], f"inline(array({', '.join(structs)}))")


def keyed_estimates(df: DataFrame, key: str) -> DataFrame:
    """``keyed_stats`` with estimated distinct counts and no value shuffle."""
    fields = df.schema.fields[:-1]
    return _estimates(df.toDF(*[f"c{i}" for i in range(len(fields))], key), _own_columns(fields), [key])


MANY_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField(POSITION, T.IntegerType(), False),
    T.StructField(NAME, T.StringType(), False),
    T.StructField("dtype", T.StringType(), False),
])


def column_stats_many(frames: Mapping[str, DataFrame]) -> DataFrame:
    """``column_stats`` of several DataFrames of any schemas in ONE job.

    All frames expand into the same ``(dataset, position, slots)`` long form
    (slots per data type across all frames), so one shuffle of distinct values
    and one per-column merge profile every table.  One plan branch per frame:
    for tables of different schemas; many files of one schema are one frame
    with a key column (``keyed_stats``).  Output ``(dataset, position,
    column_name, dtype, row_count, n_missing, n_distinct)``.
    """
    if not frames:
        raise ValueError("no frames to profile")
    spark = next(iter(frames.values())).sparkSession
    meta = spark.createDataFrame([(name, i, f.name, f.dataType.simpleString()) for name, df in frames.items()
                                  for i, f in enumerate(df.schema.fields)], MANY_SCHEMA)
    with_cols = {name: df for name, df in frames.items() if df.schema.fields}
    per_col = spark.createDataFrame([], f"dataset string, {POSITION} int, n_distinct bigint, n_rows bigint, n_miss bigint")
    if with_cols:
        slot_types = _slot_layout(list(with_cols.values()))
        long = None
        for name, df in with_cols.items():
            part = _expand(positional(df).withColumn("dataset", F.lit(name)), _own_columns(df.schema.fields),
                           slot_types, ["dataset"])
            long = part if long is None else long.unionByName(part)
        per_col = _merged(_counted(long, slot_types, ["dataset"]), ["dataset"], slot_types)
    joined = meta.join(per_col, ["dataset", POSITION], "left")
    return joined.select("dataset", POSITION, NAME, "dtype", *_counts())


def _counts() -> list[Column]:
    zero = F.lit(0)
    return [F.coalesce(F.col(c), zero).cast("bigint").alias(out) for c, out in
            (("n_rows", "row_count"), ("n_miss", "n_missing"), ("n_distinct", "n_distinct"))]


def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """``(position, column_name, n_distinct)`` -- null counts as one value."""
    return column_stats(df, exact).select(POSITION, NAME, "n_distinct")


def constant_columns(stats: DataFrame) -> DataFrame:
    """Columns with at most one distinct value (all-null and empty included)."""
    return stats.where(F.col("n_distinct") <= 1).select(POSITION, NAME)


def _atomic(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def _aligned_wanted(schema: T.StructType, wanted) -> list[T.DataType]:
    """Wanted type per position of ``schema`` (its own type where unspecified)."""
    fields = schema.fields
    if wanted is None:
        return [f.dataType for f in fields]
    listed = _wanted_fields(schema, wanted)
    if [n for _, n, _ in listed] == [f.name for f in fields]:
        return [t for _, _, t in listed]
    by_name = {n: t for _, n, t in listed}
    return [by_name.get(f.name, f.dataType) for f in fields]


def profile_columns(typed: DataFrame, raw: DataFrame | None = None, wanted=None,
                    exact: bool = True) -> DataFrame:
    """Full per-column profile, long form.

    ``typed`` drives row/missing/distinct counts; ``raw`` (default ``typed``)
    and ``wanted`` (default ``typed``'s schema) drive the bad-type count.
    Columns: position, column_name, dtype, row_count, n_missing, n_distinct,
    is_constant, n_bad.

    When the raw values are ``typed`` itself, atomic columns wanted as
    another atomic type are checked inside the profile's own job (on distinct
    values); only other checks need the separate one-pass aggregate.
    """
    fields = typed.schema.fields
    wanted_types = _aligned_wanted(typed.schema, wanted)
    fused: dict[int, T.DataType] = {}
    if (raw is None or raw is typed) and exact:
        for i, (f, t) in enumerate(zip(fields, wanted_types)):
            if (_atomic(f.dataType) and _atomic(t) and f.dataType != t
                    and not isinstance(t, T.StringType)):
                fused[i] = t
    stats = column_stats(typed, exact, bad_checks=fused or None)
    raw = typed if raw is None else raw
    rest = T.StructType([T.StructField(f.name, f.dataType if i in fused else t)
                         for i, (f, t) in enumerate(zip(fields, wanted_types))])
    bad = bad_type_counts(raw, rest).select(POSITION, F.col("n_bad").alias("n_bad_scan"))
    out = stats.join(F.broadcast(bad), POSITION, "left")   # <= C rows per side
    fused_n = F.col("n_bad") if fused else F.lit(0)
    return out.select(
        POSITION, NAME, "dtype", "row_count", "n_missing", "n_distinct",
        (F.col("n_distinct") <= 1).alias("is_constant"),
        (fused_n + F.coalesce(F.col("n_bad_scan"), F.lit(0))).cast("bigint").alias("n_bad"),
    )
