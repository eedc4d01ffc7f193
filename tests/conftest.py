import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from dqlens.session import get_spark
    s = get_spark("local[*]", 8)
    yield s


@pytest.fixture()
def tmp_text_dir(spark):
    """A fresh folder below the shared checkpoint root for CSV edge files."""
    from dqlens.session import scratch_path
    path = scratch_path(spark, "edge")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    return local


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from dqlens.sources.tables import TABLES

    def connect(sf):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        return con
    return connect
