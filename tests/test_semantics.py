"""Value semantics of the counters on hand-made frames (types Spark derives)."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from dqlens.operators import profile as P
from dqlens.operators import report as R
from dqlens.session import scratch_path
from dqlens.sources import csv as S
from dqlens.sources.tables import dirty


def _stats(df):
    return {r["column_name"]: (r["row_count"], r["n_missing"], r["n_distinct"])
            for r in P.column_stats(df).collect()}


def test_null_counts_as_one_distinct_value(spark):
    df = spark.createDataFrame([(1,), (None,), (1,), (None,)], "x int")
    assert _stats(df)["x"] == (4, 2, 2)


def test_nan_and_signed_zero(spark):
    rows = [(1.0,), (float("nan"),), (-0.0,), (0.0,), (None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "x double")
    # NaN is a value (not missing); NaN == NaN and 0.0 == -0.0 for distinctness
    assert _stats(df)["x"] == (6, 1, 4)
    assert df.distinct().count() == 4


def test_string_missing_rules(spark):
    vals = [None, "", "   ", "NaN", "nan", " nan ", "\t", "x"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    # null, '', spaces, NaN, nan are missing; ' nan ' (not trimmed) and a tab are not
    assert _stats(df)["s"] == (8, 5, 8)


def test_constant_and_all_null(spark):
    df = spark.createDataFrame([("a", None, "a"), ("a", None, None)], "c string, n string, m string")
    names = {r["column_name"] for r in P.constant_columns(P.column_stats(df)).collect()}
    assert names == {"c", "n"}           # one value plus null is not constant


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    st = _stats(df)
    assert st == {"a": (0, 0, 0), "b": (0, 0, 0)}
    rep = R.report_document(P.profile_columns(df)).first()
    assert rep["row_count"] == 0 and rep["column_count"] == 2
    assert rep["constant_columns"] == ["a", "b"]
    assert rep["suggestions"] == ["Supprimer 2 colonne(s) constante(s): a, b"]


def test_zero_columns(spark):
    df = spark.range(3).select()
    assert P.column_stats(df).count() == 0
    assert P.missing_counts(df).count() == 0


def test_dotted_and_backtick_names(spark):
    df = spark.createDataFrame([(1, "x", 2), (None, "y", 2)], "`a.b` int, `c``d` string, e int")
    st = _stats(df)
    assert st["a.b"] == (2, 1, 2) and st["c`d"] == (2, 0, 2) and st["e"] == (2, 0, 1)


def test_map_columns_are_profiled(spark):
    df = spark.createDataFrame([({"k": 1, "j": 2},), ({"j": 2, "k": 1},), (None,), ({"k": 3},)],
                               "m map<string,int>")
    assert _stats(df)["m"] == (4, 1, 3)


def test_struct_and_array_columns(spark):
    df = spark.createDataFrame([((1, "a"), [1.0, float("nan")]), ((1, "a"), [1.0, float("nan")]),
                                (None, None)], "s struct<x:int,y:string>, a array<double>")
    st = _stats(df)
    assert st["s"] == (3, 1, 2) and st["a"] == (3, 1, 2)


def test_approx_mode_is_opt_in(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("k"), F.lit(None).cast("int").alias("z"))
    exact = _stats(df)
    approx = {r["column_name"]: r["n_distinct"] for r in P.column_stats(df, exact=False).collect()}
    assert exact["k"][2] == 37 and exact["z"][2] == 1
    assert abs(approx["k"] - 37) <= 2 and approx["z"] == 1


def test_bad_types_against_declared_type(spark):
    raw = spark.createDataFrame([("1",), ("x",), ("",), (None,), (" 2",), ("3.5",)], "v string")
    bad = P.bad_type_counts(raw, {"v": "int"}).collect()
    # 'x' and '3.5' do not convert to int; blank and null are not bad
    assert [(r["column_name"], r["n_bad"]) for r in bad] == [("v", 2)]


def test_bad_types_skip_identity_and_string(spark):
    raw = spark.createDataFrame([("x", 1)], "s string, i int")
    assert P.bad_type_counts(raw).count() == 0
    assert P.bad_type_counts(raw, {"s": "string", "i": "int"}).count() == 0


def test_heavy_missing_is_strict(spark):
    rows = [(None if i < 2 else i, None if i < 3 else i) for i in range(10)]
    df = spark.createDataFrame(rows, "a int, b int")       # 20 % and 30 %
    heavy = [r["column_name"] for r in R.heavy_missing(P.column_stats(df)).collect()]
    assert heavy == ["b"]


def test_suggestion_ellipsis_after_five(spark):
    cols = ", ".join(f"c{i} string" for i in range(7))
    df = spark.createDataFrame([tuple([None] * 7)], cols)
    s = [r["suggestion"] for r in R.suggestions(P.column_stats(df)).orderBy("suggestion_no").collect()]
    assert s == ["Supprimer 7 colonne(s) constante(s): c0, c1, c2, c3, c4…",
                 "Traiter les valeurs manquantes (>20%) pour: c0, c1, c2, c3, c4…"]


def test_missing_pct_half_up(spark):
    # 1 of 8 = 12.5 % -> 12.5; 1 of 16 = 6.25 % -> 6.3 (half up on the 0.1 digit)
    df = spark.createDataFrame([(None if i == 0 else i,) for i in range(16)], "a int")
    pct = R.missing_pct(P.column_stats(df)).first()["pct"]
    assert math.isclose(pct, 6.3)


def test_many_frames_in_one_job(spark):
    a = spark.createDataFrame([(1, "x"), (1, None), (2, "nan")], "k int, s string")
    b = spark.createDataFrame([({"u": 1},), (None,)], "m map<string,int>")
    c = spark.createDataFrame([], "z double")
    got = {(r["dataset"], r["column_name"]): (r["row_count"], r["n_missing"], r["n_distinct"])
           for r in P.column_stats_many({"a": a, "b": b, "c": c}).collect()}
    assert got == {("a", "k"): (3, 0, 2), ("a", "s"): (3, 2, 3),
                   ("b", "m"): (2, 1, 2), ("c", "z"): (0, 0, 0)}
    for name, df in {"a": a, "b": b}.items():
        single = {r["column_name"]: (r["row_count"], r["n_missing"], r["n_distinct"])
                  for r in P.column_stats(df).collect()}
        assert single == {k[1]: v for k, v in got.items() if k[0] == name}


def test_repeated_column_names(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([(1, None), (2, "y")], "id int, v string")
    joined = a.join(b, a.id == b.id, "right")          # columns id, v, id, v
    st = [(r["column_name"], r["n_missing"], r["n_distinct"])
          for r in P.column_stats(joined).orderBy("position").collect()]
    assert st == [("id", 1, 2), ("v", 1, 2), ("id", 0, 2), ("v", 1, 2)]
    assert [r["n_missing"] for r in P.missing_counts(joined).orderBy("position").collect()] == [1, 1, 0, 1]
    rep = R.report_document(P.profile_columns(joined)).first()
    assert rep["column_count"] == 4 and rep["null_counts"] == {"id": 0, "v": 1}


def test_bad_types_with_repeated_names(spark):
    raw = spark.createDataFrame([("1", "x"), ("y", "2")], "a string, b string").toDF("k", "k")
    wanted = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("k", T.IntegerType())])
    got = [(r["position"], r["n_bad"]) for r in P.bad_type_counts(raw, wanted).orderBy("position").collect()]
    assert got == [(0, 1), (1, 1)]


def test_declared_types_on_non_string_columns(spark):
    df = spark.createDataFrame([(1, 2.5, 3000000000), (2, 2.0, 5), (None, None, None)],
                               "a int, b double, c bigint")
    wanted = {"a": "int", "b": "int", "c": "int"}
    fused = {r["column_name"]: r["n_bad"] for r in P.profile_columns(df, wanted=wanted).collect()}
    scan = {r["column_name"]: r["n_bad"] for r in P.bad_type_counts(df, wanted, keep_zero=True).collect()}
    # 2.5 -> int truncates under try_cast (not bad); 3e9 overflows int (bad)
    assert fused == scan == {"a": 0, "b": 0, "c": 1}


LONG = ["x" * 49, "x" * 50, "x" * 49 + "y", "y" * 49, " " * 60, " " * 61, "", "  ", None, "nan", "NaN" + " " * 60, "\0short",
        "\0" * 70, "é" * 40, "é" * 41, "z" * 48, "日本語" * 30]


def test_long_texts_are_counted_exactly(spark):
    rows = [(i, t) for i, t in enumerate(LONG * 3)]
    df = spark.createDataFrame(rows, "k int, t string")
    # a text that looks like the key of another text
    key = df.where(F.col("t") == "x" * 49).selectExpr(f"{P.text_key('t')} AS t").first()["t"]
    df = df.unionByName(spark.createDataFrame([(99, key)], "k int, t string"))
    got = {r["column_name"]: r for r in P.column_stats(df).collect()}["t"]
    assert got["n_distinct"] == len(LONG) + 1
    assert got["n_missing"] == 3 * sum(t is None or not t.strip(" ") or t.lower() == "nan" for t in LONG)


def test_colliding_first_hashes_do_not_merge_texts(spark):
    df = spark.createDataFrame([(f"{'a' * 60}{i}",) for i in range(500)] * 2, "t string")
    clash = P.text_key("t", first="int({0} IS NULL)")         # the first hash is the same for all
    assert df.selectExpr(f"{clash} AS k").distinct().count() == 500


def test_long_texts_do_not_travel(spark):
    df = spark.range(50).selectExpr("repeat(cast(id AS string), 5000) AS t")
    counted, _ = P.value_counts(df)
    assert counted.selectExpr("max(octet_length(s0)) AS n").first()["n"] < 60


def test_csv_profile_is_one_scan(spark, tmp_path):
    from dqlens.plans import jobs as J
    path = S.write_csv(dirty(spark, SF_SMALL), scratch_path(spark, "one-scan"))
    plan = P.physical_plan(J.profile_csv(spark, path))
    assert plan.count("FileScan csv") == 1
    typed = S.read_typed(spark, path)
    two = P.profile_columns(typed, S.read_raw(spark, path), typed.schema)
    assert sorted(map(tuple, J.profile_csv(spark, path).collect())) == sorted(map(tuple, two.collect()))


def test_strings_read_as_declared_types(spark):
    raw = spark.createDataFrame([("1", "x", "2024-01-02"), (" ", "y" * 60, "no date"), (None, " ", ""), ("q", "nan", "2024-01-02"),
                                 ("1.0", "x", None)], "a string, b string, c string")
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType()), T.StructField("c", T.DateType())])
    got = {r["column_name"]: (r["row_count"], r["n_missing"], r["n_distinct"], r["n_bad"])
           for r in P.profile_strings(raw, schema, {"b": "int"}).collect()}
    assert got == {"a": (5, 3, 2, 1), "b": (5, 2, 4, 4), "c": (5, 3, 2, 1)}
    rough = {r["column_name"]: (r["row_count"], r["n_missing"], r["n_bad"])
             for r in P.profile_strings(raw, schema, {"b": "int"}, exact=False).collect()}
    assert rough == {k: (v[0], v[1], v[3]) for k, v in got.items()}


def test_reports_of_any_shape(spark):
    texts = ['{"row_count": 5, "null_counts": {"a": 1, "b": "2", "c": "x", "d": null, "e": true, "f": "", "g": [1], "h": {"z": 1},'
             ' "i": 2.5, "j": " 3 ", "k": "1d", "l": -1e2}, "constant_columns": ["p", 1, null, {"q": 1}], "suggestions": "one"}',
             '{"null_counts": [1, 2], "constant_columns": null, "suggestions": 7}', '{"null_counts": "x"', None, "5",
             '{"row_count": "12"}', "[]", '{"row_count": {"a": 1}, "suggestions": []}']
    df = spark.createDataFrame(list(enumerate(texts)), "`i.d` int, t string")
    got = {r["i.d"]: r for r in R.tolerant_reports(df, "t").collect()}
    assert got[0]["null_counts"] == {"a": 1, "b": 2, "d": 0, "e": 1, "f": 0, "i": 2.5, "j": 3, "l": -100}
    assert got[0]["constant_columns"] == ["p", "1", "null", '{"q":1}'] and got[0]["suggestions"] == ["one"]
    assert [got[i]["row_count"] for i in range(8)] == [5, 0, 0, 0, 0, 12, 0, 0]
    assert all(got[i]["null_counts"] == {} and got[i]["constant_columns"] == [] for i in range(1, 8))
    assert [got[i]["suggestions"] for i in range(1, 8)] == [["7"], [], [], [], [], [], []]
