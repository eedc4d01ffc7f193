"""Queries that SQL can express, against their DuckDB oracle."""

import pytest
from conftest import SF_SMALL

from dqlens.llm.queries import ORACLE_SQL, QUERIES


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, duck, key):
    df, rel = QUERIES[key](spark, SF_SMALL), duck(SF_SMALL).sql(ORACLE_SQL[key])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in rel.select(*cols).fetchall())
