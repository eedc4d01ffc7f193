import hashlib
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dqlens.llm import fingerprint as FP


def lanes(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [list(r[0]) for r in df.orderBy("i").select(FP.fingerprint(F.col("t"))).collect()]


def plain(text):
    units = re.findall(FP.UNIT, text or "")
    words = [[int(hashlib.sha512(u.encode()).hexdigest()[15 * i:15 * i + 15], 16) for i in range(6)] for u in units]
    out = [sum(w[i] & FP._LOW for w in words) % 2 ** 30 for i in range(4)]
    out += [sum(w[i] >> 30 for w in words) % 2 ** 30 for i in range(4)] + [len(units)]
    return out + [sum((w[i] >> k) & FP._TRIPLE for w in words) % 2 ** 60 for i in (4, 5) for k in range(20)]


def test_lanes_match_plain_form(spark):
    texts = ["", None, "One. Two! Three? Four. Five.\nsix\n\n seven", "x" * 5000, "é漢 🎉.\n" * 100, "a.b.c.d.e.f"]
    assert lanes(spark, *texts) == [plain(t) for t in texts]


def test_order_insertion_and_deletion(spark):
    df = spark.createDataFrame([("a b.\nc d.\ne f", "e f\na b.\nc d.", "a b.\nc d.", "e f")], "abc string, perm string, ab string, c string")
    f = {c: FP.fingerprint(F.col(c)) for c in df.columns}
    row = df.select((f["abc"] == f["perm"]).alias("perm"), (FP.combine(f["ab"], f["c"]) == f["abc"]).alias("added"),
                    (FP.remove(f["abc"], f["c"]) == f["ab"]).alias("removed"), (f["ab"] == f["abc"]).alias("other"),
                    FP.likeness(f["abc"], f["perm"]).alias("one"), FP.likeness(f["abc"], f["ab"]).alias("part")).first()
    assert row["perm"] and row["added"] and row["removed"] and not row["other"]
    assert row["one"] == 1.0 and 0 < row["part"] < 1


def test_likeness_follows_shared_units(spark):
    lines = [f"line {i} of some text" for i in range(400)]
    df = spark.createDataFrame([(k, "\n".join(lines), "\n".join(lines[:400 - k] + [f"new {i}" for i in range(k)]))
                                for k in (0, 40, 200, 400)], "k int, a string, b string")
    got = {r["k"]: r["v"] for r in df.select("k", FP.likeness(FP.fingerprint(F.col("a")), FP.fingerprint(F.col("b"))).alias("v")).collect()}
    assert got[0] == 1.0
    for k, v in got.items():
        assert v == pytest.approx(1 - k / 400, abs=.2)


def edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        out.append((i, t, t[:len(t) - q] + nxt[:q], nxt))
    return out


def test_query_matches_plain_form(spark, small_docs):
    from dqlens.llm.queries import op9_fingerprints
    got = {r["doc_id"]: r for r in op9_fingerprints(spark, SF_SMALL).collect()}
    want = edits([(r["doc_id"], r["text"] or "") for r in small_docs.collect()])
    text_form = lambda v: "".join(f"{x:08x}" for x in v[:9]) + "".join(f"{x:015x}" for x in v[9:])
    assert len(got) == len(want)
    for i, t, e, _ in want:
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == text_form(plain(t)) and r["edited_fingerprint"] == text_form(plain(e))
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > .9 * len(got)


def test_native_plan(spark, small_docs):
    from dqlens.operators.profile import physical_plan
    assert not re.search("Python|Pandas|Arrow|Cartesian", physical_plan(FP.fingerprint_edits(small_docs)))


def test_awkward_rows(awkward, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    got = [(r["doc_id"], r["text"], r["edited"], list(r["next_lanes"])) for r in FP.fingerprint_edits(awkward).collect()]
    want = [(i, t, e, plain(n)) for i, t, e, n in edits(rows)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert FP.fingerprint_edits(no_docs).count() == 0
    one = FP.fingerprint_edits(awkward.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["edited"] == one[0]["text"][:-(len(one[0]["text"]) // 4)] + one[0]["text"][:len(one[0]["text"]) // 4]


@pytest.mark.parametrize("spread", [
    "if(id = 0, 1000000000000, id)", "id % 3 * 1000000000000 + id", "id * id * id * id",
    "if(id % 50 = 0, null, 9000000000000000000 + id)", "cast(id as string)"])
def test_buckets_are_even_however_ids_are_spread(spark, spread):
    ids = spark.range(20_000).select(F.expr(spread).alias("i"))
    sizes = {r[0]: r[1] for r in ids.groupBy(FP._bucket(ids, "i", 20)).count().collect()}
    assert max(sizes.values()) < 2 * 20_000 / 20 and len(sizes) >= 20
    rows = ids.select("i", F.hash("i").alias("v"))
    got = {r["i"]: r["next_v"] for r in FP.with_next(rows, "i", lambda d: d, ["v"], 20).where("i is not null").collect()}
    ordered = sorted((r["i"], r["v"]) for r in rows.where("i is not null").collect())
    ends = rows.orderBy(F.col("i").asc_nulls_first(), "v").first()
    assert got == {a[0]: b for a, b in zip(ordered, [*[v for _, v in ordered[1:]], ends["v"]], strict=True)}


def test_one_more_sentence_in_front_keeps_the_rest_alike(spark):
    line = [f"Sentence number {i} says {i * i}." for i in range(12)]
    cjk = [f"第{i}句话说了{i * i}。" for i in range(12)]
    df = spark.createDataFrame([(sep.join(x), sep.join([x[0] + "!", *x])) for x, sep in ((line, " "), (cjk, ""))], "a string, b string")
    for r in df.select(FP.likeness(FP.fingerprint(F.col("a")), FP.fingerprint(F.col("b"))).alias("v"),
                       F.size(FP.units(F.col("a"))).alias("n")).collect():
        assert r["n"] == 12 and r["v"] > 0.7
