"""Physical-plan properties that matter at scale (checked on small data)."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from dqlens.operators import catalog as C
from dqlens.operators import profile as P
from dqlens.plans import jobs as J
from dqlens.session import scratch_path
from dqlens.sources import csv as S
from dqlens.sources.tables import catalog_standin, dirty, table


def _plan(df) -> str:
    """The physical plan text, through the public ``explain``."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (\w+)", plan)


def test_missing_counts_needs_no_shuffle(spark):
    plan = _plan(P.missing_counts(table(spark, SF_SMALL, "lineitem")))
    # only the single-partition gather of the partial aggregates
    assert _exchanges(plan) == ["SinglePartition"]
    assert "partial_count_if" in plan or "partial_count" in plan


def test_column_stats_is_one_value_shuffle(spark):
    plan = _plan(P.column_stats(table(spark, SF_SMALL, "lineitem")))
    kinds = _exchanges(plan)
    # the value shuffle and the per-column merge, then the broadcast of the
    # C-row result; no exchange of rows
    assert kinds.count("hashpartitioning") == 2
    assert "Generate inline" in plan
    assert "partial_count(1)" in plan
    assert "BroadcastExchange" in plan


def test_profile_reads_only_needed_columns(spark):
    li = table(spark, SF_SMALL, "lineitem").select("l_returnflag", "l_quantity")
    plan = _plan(P.column_stats(li))
    scan = re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)
    assert scan == "struct<l_quantity:double,l_returnflag:string>"


def test_owner_listing_pushes_filter_to_scan(spark):
    plan = _plan(C.catalog_list(catalog_standin(spark, SF_SMALL), 42))
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,42)]" in plan


def test_point_detail_pushes_id_into_both_sides(spark):
    from dqlens.sources.tables import reports_standin
    d = C.dataset_detail(catalog_standin(spark, SF_SMALL), reports_standin(spark, SF_SMALL), 7, 5)
    plan = _plan(d)
    assert plan.count("EqualTo(o_orderkey,7)") == 2


def test_stored_catalogue_prunes_owner_partition(spark):
    store = scratch_path(spark, "plans-store")
    src = S.write_csv(dirty(spark, SF_SMALL).limit(50), scratch_path(spark, "src"))
    J.ingest_and_profile(spark, store, src, "p1", "owner-a")
    J.ingest_and_profile(spark, store, src, "p2", "owner-b")
    plan = _plan(J.list_datasets(spark, store, "owner-a"))
    assert "owner-a" in plan and "owner-b" not in plan      # only the owner's folder is listed
    assert [r["dataset_id"] for r in J.list_datasets(spark, store, "owner-a").collect()] == ["p1"]


def test_hot_value_is_combined_map_side(spark):
    # a third of all rows hold one value: partial aggregation must sit
    # before the exchange so the hot value crosses it once per task
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    stats = P.column_stats(df).first()
    assert stats["n_distinct"] == 20001 and stats["row_count"] == 30000
    plan = _plan(P.value_counts(df)[0])
    assert re.search(r"HashAggregate\(keys=\[position#\d+, flags#\d+, s0#\d+L?\], functions=\[partial_count", plan)


def test_wide_table(spark):
    n = 300
    df = spark.range(200).select(*[((F.col("id") * (i + 1)) % (i + 2)).alias(f"c{i}") for i in range(n)],
                                 F.lit(None).cast("string").alias("empty"))
    rows = {r["column_name"]: r for r in P.column_stats(df).collect()}
    assert len(rows) == n + 1
    assert rows["c0"]["n_distinct"] == 2 and rows["c9"]["n_distinct"] == 11
    assert rows["empty"]["n_missing"] == 200 and rows["empty"]["n_distinct"] == 1


def test_equal_rows_and_many_splits_make_no_row_exchange(spark):
    """Rows stay where the reader put them, however many splits or equal rows."""
    df = spark.range(0, 20000, 1, 64).select(F.lit("same").alias("k"), F.lit("x" * 50).alias("t"))
    plan = _plan(P.column_stats(df))
    assert _exchanges(plan).count("hashpartitioning") == 2      # distinct values, per-column merge
    assert "Exchange RoundRobin" not in plan
    assert [(r["n_distinct"], r["row_count"]) for r in P.column_stats(df).collect()] == [(1, 20000)] * 2


def test_declared_type_check_shares_the_profile_scan(spark):
    from dqlens.sources.tables import DIRTY_WANTED
    prof = P.profile_columns(dirty(spark, SF_SMALL), wanted=DIRTY_WANTED)
    assert _plan(prof).count("FileScan parquet") == 1
    assert {r["column_name"]: r["n_bad"] for r in prof.collect() if r["n_bad"]} == {"cust_txt": 79}


def test_all_owner_listing_is_one_range_sort(spark):
    plan = _plan(C.catalog_list_all(catalog_standin(spark, SF_SMALL)))
    assert "rangepartitioning(user_id" in plan
    assert "Window" not in plan
