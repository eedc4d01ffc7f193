"""CSV dialect edge files (FIXTURES §3): scans and profile on Spark's reader."""

import os

import pytest

from dqlens.operators import profile as P
from dqlens.sources import csv as S


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return path


def _types(df):
    return [f.dataType.simpleString() for f in df.schema.fields]


@pytest.mark.parametrize("text,dtype,n_rows", [
    ("a\n1\n2\nx\n", "string", 3),
    ("a\n2024-01-02\n2024-02-03 10:00:00\n", "timestamp", 2),
    ("a\n99999999999999999999\n", "decimal(20,0)", 1),
    ("a\n 1\n2\n", "double", 2),
])
def test_inferred_types(spark, tmp_text_dir, text, dtype, n_rows):
    path = _write(tmp_text_dir, "f.csv", text)
    df = S.read_typed(spark, path)
    assert _types(df) == [dtype] and df.count() == n_rows


def test_nan_text(spark, tmp_text_dir):
    lower = S.read_typed(spark, _write(tmp_text_dir, "l.csv", "a\n1\nnan\n"))
    upper = S.read_typed(spark, _write(tmp_text_dir, "u.csv", "a\n1\nNaN\n"))
    assert _types(lower) == ["string"] and _types(upper) == ["double"]
    assert P.missing_counts(lower).first()["n_missing"] == 1
    assert P.missing_counts(upper).first()["n_missing"] == 0


def test_all_empty_column(spark, tmp_text_dir):
    df = S.read_typed(spark, _write(tmp_text_dir, "e.csv", "a,b\n,1\n,2\n"))
    assert _types(df) == ["string", "int"]
    st = {r["column_name"]: r for r in P.column_stats(df).collect()}
    assert st["a"]["n_missing"] == 2 and st["a"]["n_distinct"] == 1


def test_header_names(spark, tmp_text_dir):
    assert S.read_typed(spark, _write(tmp_text_dir, "d.csv", "a,A,a\n1,2,3\n")).columns == ["a0", "A1", "a2"]
    assert S.read_typed(spark, _write(tmp_text_dir, "m.csv", "a,,c\n1,2,3\n")).columns == ["a", "_c1", "c"]
    dotted = S.read_typed(spark, _write(tmp_text_dir, "p.csv", "a.b\n1\n"))
    assert dotted.columns == ["a.b"]
    assert P.column_stats(dotted).first()["n_distinct"] == 1


def test_semicolon_is_one_column(spark, tmp_text_dir):
    df = S.read_typed(spark, _write(tmp_text_dir, "s.csv", "a;b\n1;2\n"))
    assert df.columns == ["a;b"] and _types(df) == ["string"]


def test_ragged_rows(spark, tmp_text_dir):
    df = S.read_typed(spark, _write(tmp_text_dir, "r.csv", "a,b\n1\n1,2,3\n4,5\n"))
    assert [tuple(r) for r in df.collect()] == [(1, None), (1, 2), (4, 5)]


def test_blank_lines_skipped_but_counted_physically(spark, tmp_text_dir):
    path = _write(tmp_text_dir, "b.csv", "a\n1\n\n2\n   ")
    assert S.read_typed(spark, path).count() == 2
    assert S.line_count(spark, path).first()["line_count"] == 5


def test_quoted_newline(spark, tmp_text_dir):
    path = _write(tmp_text_dir, "q.csv", 'a,b\n"x\ny",1\n')
    assert S.read_raw(spark, path).count() == 2
    assert S.read_raw(spark, path, multiLine=True).count() == 1


def test_empty_and_header_only(spark, tmp_text_dir):
    empty = S.read_typed(spark, _write(tmp_text_dir, "z.csv", ""))
    assert empty.columns == []
    header = S.read_typed(spark, _write(tmp_text_dir, "h.csv", "a,b\n"))
    assert _types(header) == ["string", "string"] and header.count() == 0


@pytest.mark.parametrize("text,lines", [("a\n1", 2), ("a\n1\n", 2), ("", 0), ("\n\n\n", 3),
                                        ("a\r\n1\r\n", 2), ("a\r1\r", 1)])
def test_physical_line_count(spark, tmp_text_dir, text, lines):
    path = _write(tmp_text_dir, "lc.csv", text)
    got = S.line_count(spark, path).first()["line_count"]
    assert got == lines == (text.count("\n") + (1 if text and not text.endswith("\n") else 0))


def test_row_gate(spark, tmp_text_dir):
    path = _write(tmp_text_dir, "g.csv", "a\n" + "".join(f"{i}\n" for i in range(10)))
    assert S.row_limit_gate(spark, path, 10).first()["accepted"] is True
    assert S.row_limit_gate(spark, path, 9).first()["accepted"] is False


def test_declared_type_bad_values(spark, tmp_text_dir):
    path = _write(tmp_text_dir, "t.csv", "k,v\n1,a\n2,3\nx,\n")
    raw = S.read_raw(spark, path)
    bad = {r["column_name"]: r["n_bad"] for r in P.bad_type_counts(raw, {"k": "bigint", "v": "int"}).collect()}
    assert bad == {"k": 1, "v": 1}
    typed = S.read_typed(spark, path)
    # inferred types are those of the file itself: nothing is badly typed
    assert P.bad_type_counts(raw, typed.schema).count() == 0


def test_file_listing(spark, tmp_text_dir):
    _write(tmp_text_dir, "x.CSV", "a\n1\n")
    _write(tmp_text_dir, "y.txt", "a\n1\n")
    files = S.accept_files(S.list_files(spark, tmp_text_dir))
    got = {r["name"]: r["accepted"] for r in files.collect()}
    assert got == {"x.CSV": True, "y.txt": False}


def test_timestamp_ntz_inference_survives_dst_gap(spark, tmp_text_dir):
    import datetime as dt

    from dqlens.session import session_conf
    path = _write(tmp_text_dir, "ts.csv", "t\n1995-10-15 00:00:00\n")
    with session_conf(spark, "spark.sql.session.timeZone", "America/Sao_Paulo"):
        local = S.read_typed(spark, path)
        wall = S.read_typed(spark, path, timestamp_ntz=True)
        assert _types(local) == ["timestamp"] and _types(wall) == ["timestamp_ntz"]
        # midnight does not exist that day in Sao Paulo: local time moves it
        assert wall.first()["t"] == dt.datetime(1995, 10, 15, 0, 0)
        assert local.selectExpr("CAST(t AS timestamp_ntz) AS t").first()["t"] != dt.datetime(1995, 10, 15, 0, 0)
    assert spark.conf.get("spark.sql.timestampType") == "TIMESTAMP_LTZ"


def test_known_schema_skips_inference(spark, tmp_text_dir):
    path = _write(tmp_text_dir, "k.csv", "a,b\n1,x\n2,y\n")
    sc = spark.sparkContext
    sc.setJobGroup("known-schema", "known-schema")
    try:
        df = S.read_typed(spark, path, schema="a bigint, b string")
        assert list(sc.statusTracker().getJobIdsForGroup("known-schema")) == []
    finally:
        sc.setJobGroup(None, None)
    assert _types(df) == ["bigint", "string"] and df.count() == 2


VALUES = ["1", "-1", "+1", "007", " 1", "1 ", "2147483648", "-9223372036854775808", "9223372036854775808", "1.", "1e3", ".5", "1d",
          "0x1p3", "NaN", "nan", "Inf", "+Inf", "inf", "Infinity", "infinity", "2024", "2024-01", "2024-1-2", "2024-01-02", "2024-01-02 ",
          "-2024-01-02", "+2024-01-02", "2024-01-02T10", "2024-01-02 10:00:00", "2024-01-02T10:00:00Z", "2024-02-30", "2024-01-02 25:00:00",
          "true", "False", "t", " true", "yes", "", "x", "é", "１２", "1,5", "2024-01-02T", "null", "1_000", "-", "\t1"]


def _as_spark_infers(spark, folder, texts):
    from dqlens.operators import storage as ST
    paths = {f"d{i}": _write(folder, f"m{i}.csv", t) for i, t in enumerate(texts)}
    headers = {d: ST.first_line(spark, p) for d, p in paths.items()}
    got = S.infer_many(spark, {d: ST.qualified(spark, p) for d, p in paths.items()},
                       {d: h for d, h in headers.items() if h is not None})
    for d, schema in got.items():
        want = S.read_typed(spark, paths[d]).schema
        assert [(f.name, f.dataType) for f in schema.fields] == [(f.name, f.dataType) for f in want.fields], texts[int(d[1:])]
    return got


def test_inference_together_equals_sparks_own(spark, tmp_text_dir):
    import random
    rng = random.Random(5)
    quoted = lambda v: '"' + v + '"' if "," in v else v
    texts = ["a,b\n" + quoted(v) + ",1\n" for v in VALUES]
    for _ in range(25):
        n = rng.randint(1, 4)
        pool = [rng.sample(VALUES, rng.randint(1, 3)) for _ in range(n)]
        texts.append(",".join(f"c{i}" for i in range(n)) + "\n" + "".join(
            ",".join(quoted(rng.choice(p)) for p in pool) + "\n" for _ in range(5)))
    got = _as_spark_infers(spark, tmp_text_dir, texts)
    assert len(got) >= len(texts) - 14              # beyond bigint, or digits of other scripts


def test_inference_together_of_odd_files(spark, tmp_text_dir):
    texts = ["a,A,a\n1,2,3\n", "a,,c\n1,2,3\n", "a.b\n1\n", "a;b\n1;2\n", "a,b\n,1\n,2\n", "a,b\n", "", "\n\na\n1\n",
             "a,b\n1\n2,x,9\n", "a,b\r\n1,x\r\n", "a\n1\n\n2\n", '"a",b\n1,2\n', "a\n2024-01-02\n2024-02-03 10:00:00\n", "a,b"]
    got = _as_spark_infers(spark, tmp_text_dir, texts)
    assert {"d0", "d1", "d2", "d3", "d4", "d5", "d8", "d9", "d10", "d12"} <= set(got) and "d6" not in got
