import hashlib
import re
from collections import Counter

from conftest import SF_SMALL
from dqlens.llm import substring_dedup as SUB

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width=35):
    """(n_words, spans removed, kept words) of every row, by counting windows."""
    texts = [WORD.findall(t or "") for t in rows]
    count = Counter(tuple(w[k:k + width]) for w in texts for k in range(len(w) - width + 1))
    out = []
    for w in texts:
        gone = set()
        for k in range(len(w) - width + 1):
            if count[tuple(w[k:k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_query_matches_plain_form(spark, small_docs):
    from dqlens.llm.queries import op8_substring_dedup
    rows = small_docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op8_substring_dedup(spark, SF_SMALL).collect()}
    want = plain([r["text"] for r in rows])
    assert got == {r["doc_id"]: (n, g, hashlib.sha256(k.encode()).hexdigest()) for r, (n, g, k) in zip(rows, want)}
    assert sum(g for _, g, _ in want) > 0


def test_offsets_overlaps_and_repeats_inside_one_text(spark):
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join(["x"] * 200)]                                           # a window overlapping itself
    texts += [" ".join([f"a{k}_{i}" for i in range(k)] + passage[k % 7:] + [f"b{k}_{i}" for i in range(9)]) for k in range(40)]
    texts += [" ".join(passage[:34]), " ".join(passage[:35]), " ".join(f"u{i}" for i in range(100))]
    texts += [" ".join(f"q{i}" for i in range(40)) + " mid " + " ".join(f"q{i}" for i in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in SUB.remove_repeats(df).collect()}
    assert got == dict(enumerate(plain(texts)))
    spans = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in SUB.remove_repeats(df).collect()}
    assert spans[0] == [(0, 200)] and spans[44] == [(0, 40), (41, 81)]


def test_awkward_rows(awkward, no_docs):
    rows = awkward.collect()
    got = SUB.remove_repeats(awkward, width=5).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(r["doc_id"], *p) for r, p in zip(rows, plain([r["text"] for r in rows], 5))]
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got], key=key) == sorted(want, key=key)
    assert SUB.remove_repeats(no_docs).count() == 0
