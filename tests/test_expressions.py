"""Scalar helpers: strip, display name, progress, labels, file filter."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dqlens.functions import constants as K
from dqlens.functions.expressions import (display_name, is_csv_file, pct1, progress_of,
                                          py_strip, status_label)

WS = ["\u0020", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85",
      "\xa0", "\u1680", "\u2000", "\u2007", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f",
      "\u3000", "\u200b", "\u180e", "\ufeff", "a", "\xe9", "-"]


def test_whitespace_table_matches_python():
    import sys
    spaces = {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}
    expected = {"\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\u0020",
                "\x85", "\xa0", "\u1680", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"}
    expected |= {chr(c) for c in range(0x2000, 0x200B)}
    assert spaces == expected


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(WS), max_size=8), min_size=1, max_size=20))
def test_py_strip_equals_str_strip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(py_strip(F.col("t"))).collect()]
    assert got == [t.strip() for t in texts]


def test_display_name(spark):
    df = spark.createDataFrame([(None, "f.csv"), ("  ", "f.csv"), (" My data\t", "f.csv"),
                                ("\u3000x\u3000", "g.csv")], "c string, f string")
    got = [r[0] for r in df.select(display_name(F.col("c"), F.col("f"))).collect()]
    assert got == ["f.csv", "f.csv", "My data", "x"]


def test_progress_and_labels(spark):
    codes = list(K.STATUSES) + ["weird", None]
    df = spark.createDataFrame([(c,) for c in codes], "s string")
    got = df.select(progress_of(F.col("s")), status_label(F.coalesce(F.col("s"), F.lit("queued")))).collect()
    assert [r[0] for r in got] == [0, 25, 75, 100, 100, 0, 0]
    assert got[5][1] == "weird" and got[6][1] == "En file d’attente"


def test_csv_filter(spark):
    rows = [("a.CSV", None), ("a.txt", "text/csv"), ("a.json", "application/json"), ("b.csv.gz", None),
            (None, "text/plain"), ("x", "application/vnd.ms-excel")]
    df = spark.createDataFrame(rows, "n string, m string")
    got = [r[0] for r in df.select(is_csv_file(F.col("n"), F.col("m"))).collect()]
    assert got == [True, True, False, False, True, True]


def test_pct1_zero_total(spark):
    df = spark.createDataFrame([(0, 0), (1, 3)], "n long, t long")
    assert [r[0] for r in df.select(pct1(F.col("n"), F.col("t"))).collect()] == [0.0, 33.3]
