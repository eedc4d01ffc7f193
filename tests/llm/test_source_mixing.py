import hashlib
import math
import re
from collections import defaultdict

import pytest

from conftest import SF_MID
from dqlens.llm import source_mixing as MX

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    """Water filling as told: cap, share the excess by weight, repeat."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free = dict.fromkeys(names, 0.0), set(names)
    left = share * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        full = {s for s in free if left * w[s] / total >= most * sizes[s]}
        if not full:
            for s in free:
                out[s] = left * w[s] / total
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def plain(rows):
    """Decisions by sorting each source (rows: id, source, text)."""
    sizes, docs = defaultdict(int), defaultdict(list)
    for i, s, t in rows:
        n = len(WORD.findall(t or ""))
        q = max(.2, 1 - 4 * len(re.findall(r"[#*$%&|<>]", t or "")) / max(1, len(t or "")))
        u = int(hashlib.md5(f"mix|{'' if i is None else i}".encode()).hexdigest()[:12], 16)
        sizes[s] += n
        docs[s].append((-math.log((u + .5) / 2 ** 48) / q, i, n))
    taken = {}
    want = targets(sizes)
    for s, mine in docs.items():
        epochs = int(want[s] // sizes[s]) if sizes[s] else 0
        budget, fits, cut = want[s] - epochs * sizes[s], 0, False
        chosen = set()
        for key, i, n in sorted(mine, key=lambda x: (x[0], -1 if x[1] is None else x[1])):
            cut = cut or fits + n > budget
            if not cut and budget > 0:
                chosen.add((key, i))
                fits += n
        rest = budget - fits
        for _ in range(MX.CLOSING if cut else 0):
            other = [(abs(n - rest), key, i, n) for key, i, n in mine if (key, i) not in chosen and n > 0 and abs(n - rest) < rest]
            if not other:
                break
            _, key, i, n = min(other)
            chosen.add((key, i))
            rest -= n
        for key, i, n in mine:
            taken[i] = (n, sizes[s], want[s], n * (epochs + ((key, i) in chosen)))
    return taken


def test_matches_plain_form(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    want = plain([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()])
    from dqlens.llm.queries import op6_mix_sources
    got = op6_mix_sources(spark, SF_MID).collect()
    assert len(got) == len(want)
    for r in got:
        n, size, target, taken = want[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"]) == (n, size, taken), r
        assert r["target"] == pytest.approx(target, rel=1e-9)
        assert r["taken"] <= 2 * r["size"]


def test_native_plan(spark):
    from dqlens.operators.profile import physical_plan
    plan = physical_plan(MX.mix_sources(spark.read.parquet(f"{SF_MID}/documents.parquet")))
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_one_hot_source_is_split(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "w " * (1 + i % 17)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = MX.mix_sources(df).collect()
    want = plain(rows)
    assert all(r["taken"] == want[r["doc_id"]][3] for r in got)


def test_awkward_rows(awkward, no_docs):
    rows = awkward.collect()
    got = MX.mix_sources(awkward).collect()
    assert len(got) == len(rows)
    by_source = defaultdict(int)
    for r in rows:
        by_source[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = targets(by_source)
    for r in got:
        assert r["source_size"] == by_source[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    mixed = MX.apply_mix(awkward)
    assert mixed.columns == awkward.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert MX.mix_sources(no_docs).count() == 0 and MX.apply_mix(no_docs).count() == 0
    assert [tuple(r) for r in MX.mix_sources(awkward).orderBy("doc_id", "source", "size").collect()] == \
        [tuple(r) for r in MX.mix_sources(awkward.repartition(3)).orderBy("doc_id", "source", "size").collect()]
