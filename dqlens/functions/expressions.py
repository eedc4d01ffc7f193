"""Column expressions used by the profiler and the catalogue.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen; nothing is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.functions import constants as K


def quote(name: str) -> str:
    """Backtick-quote a column name (dots, spaces, backticks are literal)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """``F.col`` for a raw field name, safe for names such as ``a.b``."""
    return F.col(quote(name))


def sql_string(text: str) -> str:
    """A SQL string literal for ``text`` (backslash escapes, Spark's default)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def missing_sql(name: str, dtype: T.DataType) -> str:
    """SQL text of the missing-value predicate of a column.

    String columns: null, only spaces (``trim`` strips spaces, not tabs), or
    exactly ``nan`` in any case (not trimmed).  Every other type: null only --
    a floating ``NaN`` is a value.  SQL text, so that a wide aggregate is built
    in one call.
    """
    q = quote(name)
    if isinstance(dtype, T.StringType):
        return (f"({q} IS NULL OR length(trim({q})) = 0 OR lower({q}) = "
                f"{sql_string(K.MISSING_TEXT)})")
    return f"({q} IS NULL)"


def bad_value(raw: Column, wanted: T.DataType) -> Column:
    """A non-blank value that does not convert to ``wanted``.  (Null and blank
    values are not bad, whatever they convert to.)"""
    return (F.length(F.trim(raw)) > 0) & raw.try_cast(wanted).isNull()


def progress_of(status: Column) -> Column:
    """Status -> progress 0..100; absent status is queued, unknown is 0."""
    s = F.coalesce(status, F.lit(K.DEFAULT_STATUS))
    out = None
    for code, pct in K.STATUS_PROGRESS.items():
        out = (F.when(s == code, F.lit(pct)) if out is None
               else out.when(s == code, F.lit(pct)))
    return out.otherwise(F.lit(K.UNKNOWN_PROGRESS))


def _label(code: Column, labels: dict[str, str]) -> Column:
    out = None
    for key, text in labels.items():
        out = (F.when(code == key, F.lit(text)) if out is None
               else out.when(code == key, F.lit(text)))
    return out.otherwise(code)


def status_label(status: Column) -> Column:
    """French label of a status code; an unknown code is shown as-is."""
    return _label(status, K.STATUS_LABELS)


def step_label(step: Column) -> Column:
    return _label(step, K.STEP_LABELS)


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` semantics (all Unicode whitespace)."""
    cls = K.STRIP_CHARS_CLASS
    return F.regexp_replace(c, f"^{cls}+|{cls}+$", "")


def display_name(custom_name: Column, filename: Column) -> Column:
    """Stripped custom name when non-empty, else the file name."""
    return F.coalesce(F.nullif(py_strip(custom_name), F.lit("")), filename)


def clean_custom_name(custom_name: Column) -> Column:
    """What the catalogue stores as ``custom_name``: stripped, empty -> null."""
    return F.nullif(py_strip(custom_name), F.lit(""))


def pct1(n: Column, total: Column) -> Column:
    """Percentage with one decimal, rounded half up; zero total gives 0."""
    ratio = F.try_divide(n.cast("double"), total.cast("double"))
    return F.when(total > 0, F.floor(ratio * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


def is_csv_file(name: Column, mime: Column | None = None) -> Column:
    """Upload filter: MIME in the allowed set, or a ``.csv`` name (any case)."""
    by_name = F.coalesce(F.lower(name).endswith(K.CSV_SUFFIX), F.lit(False))
    if mime is None:
        return by_name
    return by_name | F.coalesce(mime.isin(*K.ALLOWED_MIME), F.lit(False))


def head_list_text(names: Column) -> Column:
    """First five names joined by ``, `` and an ellipsis when there are more."""
    shown = F.array_join(F.slice(names, 1, K.SUGGESTION_LIST_HEAD), K.NAME_SEPARATOR)
    more = F.when(F.size(names) > K.SUGGESTION_LIST_HEAD, F.lit(K.ELLIPSIS)).otherwise(F.lit(""))
    return F.concat(shown, more)


def suggestion_texts(constant_names: Column, heavy_names: Column) -> Column:
    """The 0-2 cleaning suggestions, constant columns first."""
    drop = F.concat(
        F.lit(K.SUGGEST_DROP_CONSTANT.split("{n}")[0]),
        F.size(constant_names).cast("string"),
        F.lit(K.SUGGEST_DROP_CONSTANT.split("{n}")[1]),
        head_list_text(constant_names),
    )
    treat = F.concat(F.lit(K.SUGGEST_TREAT_MISSING), head_list_text(heavy_names))
    parts = F.array(
        F.when(F.size(constant_names) > 0, drop),
        F.when(F.size(heavy_names) > 0, treat),
    )
    return F.filter(parts, lambda x: x.isNotNull())
