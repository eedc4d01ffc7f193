import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dqlens.llm import quality_rules as QR

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if grams[tuple(words[k:k + 5])] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


@pytest.mark.parametrize("text", [None, "", " ", "a b c d e", "a b c d e a b c d e", "x " * 50, "l\nl\n\n \nl",
                                  " ".join(str(i * i % 9001) for i in range(20_000))])
def test_counts_match_plain_form(text):
    assert QR.measure(text)[:5] == plain(text)


def test_counts_on_table(spark, small_docs):
    rows = {r["id"]: tuple(r[c] for c in QR.COUNTS) for r in QR.signals(small_docs).collect()}
    assert rows == {r["doc_id"]: plain(r["text"]) for r in small_docs.collect()}


@pytest.mark.parametrize("n,p", [(1, .5), (20, .05), (400, .01), (1000, .3)])
def test_binomial_is_exact(n, p):
    for k in {0, 1, n // 20, n // 3, n - 1, n}:
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)) if n < 500 else None
        if want is not None:
            assert QR.binomial_cdf(k, n, p) == pytest.approx(want, abs=1e-12)
    bound = QR.upper_bound(0, n, .05)
    assert (1 - bound) ** n == pytest.approx(.05, rel=1e-6)


def made(spark, n_good, n_bad, good_high):
    """Good texts have 0 % symbols but for ``good_high`` of them, bad ones 40 %."""
    rows = [(i, "s", 0 if i >= good_high else 40, 1) for i in range(n_good)]
    rows += [(n_good + i, "s", 40, 0) for i in range(n_bad)]
    df = spark.createDataFrame(rows, "id long, stratum string, symbol_share int, quality int")
    for c in QR.SIGNALS[1:]:
        df = df.withColumn(c, F.lit(0))
    measured = df.drop("quality").withColumn("base_failed", F.lit(False)).withColumn("text_key", F.col("id"))
    return measured, df.select(F.col("id").alias("doc_id"), "quality")


def test_certified_cut_is_used_and_bounded(spark):
    measured, labels = made(spark, 3000, 300, 0)
    cuts = QR.calibrate(measured, labels).collect()
    assert [(c["signal"], c["cut"], c["good_rejected"], c["bad_rejected"]) for c in cuts] == [("symbol_share", 40, 0, 300)]
    assert cuts[0]["risk_bound"] <= QR.ALPHA / len(QR.SIGNALS)
    kept = QR.apply_rules(measured, QR.calibrate(measured, labels))
    assert kept.where("kept").count() == 3000


def test_no_rule_without_enough_labels_or_with_too_many_false_rejections(spark):
    assert QR.calibrate(*made(spark, 40, 40, 0)).count() == 0
    assert QR.calibrate(*made(spark, 3000, 300, 200)).count() == 0


def test_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(0, 1), (0, 1), (None, 1), (99, 0), (5, None)], "doc_id long, quality int")
    out = QR.judge(awkward, labels)
    assert out.count() == awkward.count()
    verdicts = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in out.collect()}
    assert verdicts[3] == (True, False) and verdicts[4] == (True, False) and verdicts[9] == (False, True)
    assert QR.judge(no_docs, labels.where("false")).count() == 0


def test_query_keeps_good_rows(spark):
    from dqlens.llm.queries import op1_quality_rules
    out = op1_quality_rules(spark, SF_SMALL)
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    good = out.join(labels.where("quality = 1"), "doc_id")
    assert out.count() == 200 and good.where("NOT kept AND NOT base_failed").count() == 0


def test_copies_and_repeated_labels_are_one_draw(spark):
    measured, labels = made(spark, 100, 100, 0)
    assert QR.calibrate(measured, labels, min_good=1).count() == 0
    many = labels.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("k")
    copies = measured.withColumn("id", F.explode(F.sequence(F.col("id"), F.col("id") + 19000, F.lit(1000))))
    assert QR.calibrate(measured, many, min_good=1).count() == 0
    assert QR.calibrate(copies, labels.withColumn("doc_id", F.explode(F.sequence(F.col("doc_id"), F.col("doc_id") + 19000, F.lit(1000)))),
                        min_good=1).count() == 0


def chosen_by_hand(rows, alpha, delta, penalty, min_good):
    """rows: (stratum, text, shares, good); every cut of every chain is tried."""
    draws = {}
    for stratum, text, shares, good in rows:
        draws[stratum, text] = (shares, max(good, draws.get((stratum, text), (0, 0))[1]))
    strata = {s for s, _ in draws}
    n_good = {s: sum(g for (t, _), (_, g) in draws.items() if t == s) for s in strata}
    strata = [s for s in strata if n_good[s] >= min_good]
    level, out = delta / max(1, 3 * len(strata)), {}
    for s in strata:
        for k, signal in enumerate(QR.SIGNALS):
            mine = [(x[k], g) for (t, _), (x, g) in draws.items() if t == s]
            best = None
            for cut in sorted({x for x, _ in mine}, reverse=True):
                lost = sum(g for x, g in mine if x >= cut)
                caught = sum(1 - g for x, g in mine if x >= cut)
                p, n = alpha / 3, n_good[s]
                tail = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(lost + 1))
                if tail > level:
                    break
                gain = caught - penalty * lost
                if cut > 0 and gain > 0 and (best is None or (gain, cut) > best[:2]):
                    best = (gain, cut, lost, n, caught)
            if best:
                out[s, signal] = best[1:]
    return out


def test_calibration_equals_trying_every_cut(spark):
    import random
    rng = random.Random(11)
    rows = []
    for i in range(2600):
        stratum, good = rng.choice(["a", "a", "b", None, f"junk{i % 300}"]), int(rng.random() < .7)
        base = [0, 3, 10] if good else [20, 8, 30]
        text = i if rng.random() < .9 else rng.randrange(i + 1)
        rows.append((stratum, text, [max(0, min(100, int(rng.gauss(b, 6)))) for b in base], good))
    first = {}
    rows = [(s, t, first.setdefault((s, t), x), g) for s, t, x, g in rows]      # one text has one share
    df = spark.createDataFrame([(i, s, t, *x, False, g) for i, (s, t, x, g) in enumerate(rows)],
                               ["id", "stratum", "text_key", *QR.SIGNALS, "base_failed", "quality"])
    cuts = QR.calibrate(df.drop("quality"), df.select(F.col("id").alias("doc_id"), "quality"), alpha=.1, min_good=150).collect()
    got = {(c["stratum"], c["signal"]): (c["cut"], c["good_rejected"], c["n_good"], c["bad_rejected"]) for c in cuts}
    assert got == chosen_by_hand(rows, .1, QR.DELTA, QR.PENALTY, 150) and len({s for s, _ in got}) == 3
