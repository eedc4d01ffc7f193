import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dqlens.llm import katz_lm as LM

END = b""


def plain(docs, train):
    """Katz bigram model and scores by dictionaries."""
    texts = {i: (t or "").encode().lower().split() + [END] for i, t in docs}
    uni, bi = Counter(), Counter()
    for i, w in texts.items():
        if train(i):
            uni.update(w)
            bi.update(zip([END] + w[:-1], w))
    total, distinct = sum(uni.values()), len(uni)
    sizes = lambda c: [sum(v == r for v in c.values()) for r in range(1, LM.K + 2)]
    d1, d2 = LM.discounts(sizes(uni)), LM.discounts(sizes(bi))
    d = lambda c, t: t[c] if c <= LM.K else 1.0
    used = sum(d(c, d1) * c for c in uni.values())
    spare = total - used <= 0
    norm = total + 1 if spare else total
    unk = 1.0 if not total else 1 / norm if spare else (total - used) / total
    p1 = lambda w: d(uni[w], d1) * uni[w] / norm if w in uni else unk
    after = defaultdict(list)
    for (h, w), c in bi.items():
        after[h].append((w, c))
    tot, alpha = {}, {}
    for h, seen in after.items():
        n = sum(c for _, c in seen)
        left = n - sum(d(c, d2) * c for _, c in seen)
        tot[h], left = (n + 1, 1.0) if left <= 1e-9 * n else (n, left)
        alpha[h] = left / tot[h] / (1 - sum(p1(w) for w, _ in seen))
    p2 = lambda h, w: (d(bi[h, w], d2) * bi[h, w] / tot[h] if (h, w) in bi
                       else alpha[h] * p1(w) if h in tot else p1(w))
    rows = {}
    for i, w in texts.items():
        rows[i] = (len(w), sum(x in uni for x in w), total,
                   sum(math.log10((uni[x] + .1) / (total + .1 * (distinct + 1))) for x in w),
                   sum(math.log10(p2(h, x)) for h, x in zip([END] + w[:-1], w)))
    mass = {h: sum(p2(h, w) for w in uni) + p2(h, b"\0never") for h in list(after)[:5]}
    return rows, mass


def held_out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_scores_match_plain_katz(spark, small_docs):
    from dqlens.llm.queries import op3_katz_lm
    got = {r["doc_id"]: r for r in op3_katz_lm(spark, SF_SMALL).collect()}
    want, mass = plain([(r["doc_id"], r["text"]) for r in small_docs.collect()], lambda i: not held_out(i))
    assert all(m == pytest.approx(1, abs=1e-9) for m in mass.values())
    assert set(got) == set(want)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held_out(i))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_hot_history_split_over_parts(spark):
    """One word is nearly every history: its sums are put together again."""
    docs = [(i, " ".join(f"hot v{(i * 31 + k) % 400}" for k in range(40))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in LM.score_texts(df, F.col("doc_id") % 3 != 0).collect()}
    want, mass = plain(docs, lambda i: i % 3 != 0)
    assert all(m == pytest.approx(1, abs=1e-9) for m in mass.values())
    assert all(got[i] == pytest.approx(want[i][4], rel=1e-9) for i in want)


def test_awkward_rows(awkward, no_docs):
    rows = LM.score_texts(awkward, F.col("doc_id") > 5).collect()
    assert len(rows) == awkward.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["n_tokens"] == 1 and by_id[4]["n_tokens"] == 1 and not by_id[None]["train"]
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    nothing = LM.score_texts(awkward, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in nothing)
    assert LM.score_texts(no_docs, F.lit(True)).count() == 0
