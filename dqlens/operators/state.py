"""Profiles that grow with their data.

A state holds, for every column, each distinct value as it was read (a string)
with its count.  States of different files are merged by adding counts, and a
profile comes from the merged state alone: a folder that gains a file is not
read again.  Types are not fixed when a value is counted -- a later file may turn
an int column into a double one -- so a value also carries the kinds it can be
read as, and the profile converts the distinct values.

Texts of more than ``LONGEST_TEXT_KEY`` bytes that are nothing but text stand in
the state by their hashes (``profile.text_key``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.functions.expressions import missing_sql, quote
from dqlens.operators.profile import NAME, POSITION, hashed_text, text_key
from dqlens.sources import csv as S

#: what a state says of a value, after the keys
VALUE_FIELDS = f"{POSITION} int, value string, kind int, missing boolean, cnt bigint"


def value_state(raw: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, position, value, kind, missing, cnt)`` of a scan of strings;
    ``keys`` are its last columns.  One scan; the shuffle carries each distinct
    value of a task once.  What a value can be read as is found once per distinct
    value, after counting; only values that may travel as a key are looked at
    where they are read."""
    n = len(raw.columns) - len(keys)
    src = raw.toDF(*[f"c{i}" for i in range(n)], *keys)
    head = [f"'{k}', {quote(k)}" for k in keys]
    structs = ["named_struct(" + ", ".join([*head, f"'{POSITION}', {i}", f"'value', c{i}"]) + ")" for i in range(n)]
    # expressions stand behind the expansion: once each, not once per column, or the generated loop outgrows the JIT
    long = src.selectExpr("inline(array(" + ", ".join(structs) + "))")
    long = long.withColumn("kind", F.when(F.expr(hashed_text("value")), S.value_kind(F.col("value"))))
    missing = missing_sql("value", T.StringType())
    long = long.select(*keys, POSITION, F.expr(f"if(kind = {S.STRING}, {text_key('value')}, value) AS value"), "kind",
                       F.expr(f"if(kind IS NULL, NULL, {missing}) AS missing"))
    counted = long.groupBy(*keys, POSITION, "value", "kind", "missing").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select(*keys, POSITION, "value", F.coalesce("kind", S.value_kind(F.col("value"))).alias("kind"),
                          F.expr(f"coalesce(missing, {missing}) AS missing"), "cnt")


def merged(state: DataFrame, keys: list[str]) -> DataFrame:
    """States of several files, counted together."""
    return state.groupBy(*keys, POSITION, "value", "kind", "missing").agg(F.sum("cnt").alias("cnt"))


def _dtype_sql(kinds: str) -> str:
    """SQL text of ``csv.column_type``, null where Spark's own inference must decide."""
    cases = "".join(f" WHEN {kinds} <> 0 AND {kinds} & ~{held} = 0 THEN '{t.simpleString()}'" for held, t in S.KIND_TYPES)
    return f"CASE WHEN {kinds} & {S.OTHER} <> 0 THEN NULL{cases} ELSE 'string' END"


def profile_of_state(state: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """The long-form profile of merged states: ``(*keys, position, column_name,
    dtype, row_count, n_missing, n_distinct, is_constant, n_bad)``.

    ``names``: ``(*keys, position, column_name)``; columns of it without a state
    have no rows.  ``dtype`` is null where the values alone do not tell the
    type (``csv.value_kind``), and the counts are then those of strings."""
    at = [*keys, POSITION]
    types = state.groupBy(*at).agg(F.bit_or("kind").alias("kinds")).select(*at, F.expr(f"{_dtype_sql('kinds')} AS dtype"))
    # one spelling per value of the column's type: 1, 01 and +1 are one int
    same = F.expr("""CASE dtype WHEN 'int' THEN cast(try_cast(value AS bigint) AS string)
        WHEN 'bigint' THEN cast(try_cast(value AS bigint) AS string)
        WHEN 'double' THEN cast(try_cast(value AS double) + 0.0D AS string)
        WHEN 'date' THEN cast(try_cast(value AS date) AS string)
        WHEN 'timestamp' THEN cast(unix_micros(try_cast(value AS timestamp)) AS string)
        WHEN 'boolean' THEN lower(value) ELSE value END""")
    # as many rows as columns, broadcast: a shuffle by column would hand all of its values to one task
    values = state.join(F.broadcast(types), at).withColumn("same", same)
    lost = F.expr("if(dtype = 'string' OR dtype IS NULL, missing, same IS NULL)")
    counted = values.withColumn("lost", lost).groupBy(*at, "dtype", "same", "lost").agg(F.sum("cnt").alias("cnt"))
    stats = counted.groupBy(*at, "dtype").agg(
        F.sum("cnt").alias("n_rows"), F.expr("sum(if(lost, cnt, 0)) AS n_miss"),
        F.expr("count_if(same IS NOT NULL) + max(if(same IS NULL, 1, 0)) AS n_distinct"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    known = F.when(F.col("n_rows").isNull(), F.lit("string")).otherwise(F.col("dtype"))
    return names.join(stats, at, "left").select(
        *at, NAME, known.alias("dtype"), count("n_rows").alias("row_count"), count("n_miss").alias("n_missing"),
        count("n_distinct").alias("n_distinct"), (count("n_distinct") <= 1).alias("is_constant"),
        F.lit(0).cast("bigint").alias("n_bad"))
