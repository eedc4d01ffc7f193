"""Every registered query against its DuckDB oracle (the driver's gate)."""

import hashlib
import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from dqlens.plans.registry import all_oracles, all_queries

KEYS = sorted(all_queries())


def _canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_canon(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_every_query_has_an_oracle_and_is_registered():
    assert set(all_queries()) == set(all_oracles()) <= set(E.queries())
    assert set(all_oracles()) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = all_queries()[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck(SF_SMALL).sql(all_oracles()[key])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(rel.columns, orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 6
    assert df.columns == ["column_name", "dtype", "row_count", "n_missing", "n_distinct",
                          "is_constant", "n_bad"]
