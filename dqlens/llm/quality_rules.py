"""Quality rules with risk-controlled thresholds.

Signals of a text are shares in percent.  For every stratum (by default the
language) and signal, each whole percent is a candidate cut: "reject if the
share is at least c".  All labelled rows form the holdout (the candidates are
fixed beforehand, so none are needed to choose them).  Cuts are tested from
the mildest to the strictest with the exact binomial test of "this cut
rejects more than ``alpha`` of the good texts", and testing stops at the first
that is not refuted: a fixed sequence, so one chain of cuts costs one test.
The chains are corrected by Bonferroni (``delta`` over their number), and a
stratum's ``alpha`` is shared by its signals, so with probability
``1 - delta`` no stratum loses more than ``alpha`` of its good texts to all
rules together.  The bound is about independent draws, so a draw is a distinct
text of a stratum: copies, repeated ids and repeated labels add nothing, and a
text with labels of both kinds counts as good.  Strata with fewer than
``MIN_GOOD`` good draws have no rules and cost no chain (even without a false
rejection they could not certify a cut), so that junk strata do not weaken the
others.  Among the certified cuts the one with the best balance
(bad texts rejected minus ``PENALTY`` times good ones) is used; where none
helps, or too few labels are there to certify one, the rule is off.

The counts are pre-aggregated per (stratum, signal, percent), so any number
of labels, and a stratum with most of the rows, costs a few hundred numbers.

Defined cases: a null text has no words (all signals 0, it fails the base
rule); a null stratum is a stratum; labels that are null, or whose id is null
or not found, do not count; repeated rows and labels are one draw; no labels,
or few in a stratum: base rule only; texts of any length are measured whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.llm.common import WORD, ship_code, stored

ALPHA = 0.05         # share of a stratum's good texts that may be lost to the rules
DELTA = 0.05         # probability that any stratum loses more
PENALTY = 5          # bad texts that must go for each good one
MIN_GOOD = 200       # good draws that a stratum needs to have rules

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SIGNALS = ("symbol_share", "upper_share", "dup_line_share")


def repeated_words(words: list[str], width: int = REPEAT_WINDOW) -> int:
    """Words covered by windows of ``width`` words that occur at least twice."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == n:
        return 0
    # exact codes: packed where they fit in 63 bits, else ranked step by step
    code, base = ids[:n - width + 1].copy(), len(seen)
    top = base
    for k in range(1, width):
        if top * base >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            top = n
        code = code * base + ids[k:n - width + 1 + k]
        top *= base
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(code, twice))
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple:
    """The counts, then the signals (whole percent) of one text."""
    text = text or ""
    words = WORD.findall(text)
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    percent = lambda part, whole: min(100, 100 * part // whole) if whole else 0
    return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat,
            percent(n_symbols, word_chars), percent(len(UPPER.findall(text)), word_chars),
            percent(n_dup_lines, len(lines)))


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, text_key, counts, signals, base_failed) of every row."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"),
                       F.col(text_col).alias("text"))
    fields = rows.schema.fields[:2] + [T.StructField(c, T.LongType()) for c in COUNTS] + \
        [T.StructField(c, T.IntegerType()) for c in SIGNALS]

    def run(batches):
        for batch in batches:
            got = np.array([measure(t.as_py()) for t in batch.column(2)], np.int64).reshape(-1, len(fields) - 3)
            arrays = [batch.column(0), batch.column(1), batch.column(3)]
            arrays += [pa.array(got[:, k]) for k in range(len(COUNTS))]
            arrays += [pa.array(got[:, k].astype(np.int32)) for k in range(len(COUNTS), len(fields) - 3)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    out = rows.withColumn("text_key", F.xxhash64("text")).select("id", "stratum", "text", "text_key")
    fields.insert(2, T.StructField("text_key", T.LongType()))
    out = out.mapInArrow(run, T.StructType(fields))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))


# --------------------------------------------------------------------------
# exact binomial bounds
# --------------------------------------------------------------------------

def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed from its largest term outwards."""
    if k >= n:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    if p <= 0:
        return 1.0
    lower = k < n * p
    i = k if lower else k + 1
    log_term = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                + i * math.log(p) + (n - i) * math.log1p(-p))
    term = total = 1.0
    if lower:
        while i > 0 and term > total * 1e-18:
            term *= i * (1 - p) / ((n - i + 1) * p)
            total += term
            i -= 1
    else:
        while i < n and term > total * 1e-18:
            term *= (n - i) * p / ((i + 1) * (1 - p))
            total += term
            i += 1
    mass = math.exp(min(0.0, log_term + math.log(total)))
    return mass if lower else max(0.0, 1.0 - mass)


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate that ``k`` of ``n`` does not refute at ``level``."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > level else (low, mid)
    return high


@F.pandas_udf(T.DoubleType())
def _tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_cdf(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def _bound(k: pd.Series, n: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([upper_bound(int(a), int(b), float(c)) for a, b, c in zip(k, n, level, strict=True)],
                     dtype="float64")


def calibrate(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
              alpha: float = ALPHA, delta: float = DELTA, penalty: float = PENALTY,
              min_good: int = MIN_GOOD) -> DataFrame:
    """Chosen cuts: (stratum, signal, cut, good_rejected, n_good, bad_rejected, risk_bound)."""
    ship_code(measured.sparkSession)
    marks = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("good")) \
        .where(F.col("good").isin(0, 1))
    known = measured.where(~F.col("base_failed")).join(marks, F.col("id") == F.col("label_id"))
    known = known.groupBy("stratum", "text_key").agg(F.max("good").alias("good"), *[F.max(c).alias(c) for c in SIGNALS])
    long = known.select("stratum", "good", F.explode(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(s).alias("share")) for s in SIGNALS])).alias("x"))
    counts = long.groupBy("stratum", F.col("x.signal").alias("signal"), F.col("x.share").alias("share")).agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    chain = Window.partitionBy("stratum", "signal")
    down = chain.orderBy(F.desc("share"))
    # cuts between two observed shares reject the same rows, so the observed ones stand for all
    cuts = counts.select(
        "stratum", "signal", F.col("share").alias("cut"), F.sum("good").over(chain).alias("n_good"),
        F.sum("good").over(down).alias("good_rejected"), F.sum("bad").over(down).alias("bad_rejected"))
    cuts = stored(cuts.where(F.col("n_good") >= min_good), "risk-cuts")
    n_chains = cuts.select("stratum").distinct().count() * len(SIGNALS)
    level = delta / max(1, n_chains)
    tested = cuts.withColumn("p", _tail("good_rejected", "n_good", F.lit(alpha / len(SIGNALS))))
    stop = F.max(F.when(F.col("p") > level, F.col("cut"))).over(chain)
    gain = F.col("bad_rejected") - F.col("good_rejected") * penalty
    sure = tested.withColumn("stop", stop).where(
        (F.col("stop").isNull() | (F.col("cut") > F.col("stop"))) & (F.col("cut") > 0)
        & (gain > 0)).withColumn("gain", gain)
    best = sure.groupBy("stratum", "signal").agg(F.max(F.struct(
        "gain", "cut", "good_rejected", "n_good", "bad_rejected")).alias("b"))
    return best.select("stratum", "signal", "b.cut", "b.good_rejected", "b.n_good", "b.bad_rejected",
                       _bound("b.good_rejected", "b.n_good", F.lit(level)).alias("risk_bound"))


def apply_rules(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with ``fired`` (names of the rules that reject) and ``kept``."""
    per_stratum = cuts.groupBy("stratum").agg(F.map_from_entries(
        F.collect_list(F.struct("signal", "cut"))).alias("cuts")).withColumnRenamed("stratum", "cut_stratum")
    per_stratum = stored(per_stratum, "risk-rules")     # one row per stratum: Spark knows its size
    joined = measured.join(per_stratum, measured["stratum"].eqNullSafe(per_stratum["cut_stratum"]), "left")
    fires = [F.when(F.col(s) >= F.col("cuts")[s], F.lit(s)) for s in SIGNALS]
    fired = F.filter(F.array(*fires), lambda x: x.isNotNull())
    return joined.withColumn("fired", F.when(F.col("cuts").isNull(), F.array().cast("array<string>"))
                             .otherwise(fired)).withColumn(
        "kept", ~F.col("base_failed") & (F.size("fired") == 0)).drop("cuts", "cut_stratum")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str = "lang", label_col: str = "quality", alpha: float = ALPHA,
          delta: float = DELTA) -> DataFrame:
    """Signals, calibrated rules and verdict of every document."""
    measured = stored(signals(docs, id_col, text_col, stratum_col), "risk-signals")
    cuts = calibrate(measured, labels, id_col, label_col, alpha, delta)
    return apply_rules(measured, cuts).withColumnRenamed("id", id_col)
