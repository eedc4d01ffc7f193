import random

import pytest

from conftest import SF_SMALL
from dqlens.llm import jaccard_join as JJ


def gram_sets(rows, width):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < width else \
            frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1))
    return out


def plain(rows, width, num, den):
    """Components by comparing all pairs of sets that are close in size."""
    sets = gram_sets(rows, width)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets, key=lambda i: len(sets[i]))
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            if not a or len(a) * den < len(b) * num:
                if a:
                    break
                continue
            same = len(a & b)
            if same * den >= num * (len(a) + len(b) - same):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def found(df, **how):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in JJ.jaccard_components(df, **how).collect()}


def test_query_matches_all_pairs(spark, small_docs):
    from dqlens.llm.queries import op10_jaccard_join
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_jaccard_join(spark, SF_SMALL).collect()}
    assert got == plain(rows, 3, 90, 100)


@pytest.mark.parametrize("width,threshold", [(3, (90, 100)), (5, (80, 100))])
def test_chains_outliers_and_common_passages(spark, width, threshold):
    """Copies with more and more edits: some link to the base, some only to
    each other, some to nothing; all share a passage."""
    rng = random.Random(width)
    texts, passage = [], [f"c{i}" for i in range(30)]
    for base in range(4):
        words = [f"b{base}_{rng.randrange(10 ** 6)}" for _ in range(150)]
        texts.append(words)
        for k in range(45):
            copy = list(words)
            for _ in range(k % 12):
                copy[rng.randrange(150)] = f"e{rng.randrange(10 ** 6)}"
            texts.append(copy)
        chain = list(words)
        for step in range(12):                       # a chain of small steps away from the base
            chain = list(chain)
            for _ in range(2):
                chain[rng.randrange(150)] = f"s{base}_{step}_{rng.randrange(10 ** 6)}"
            texts.append(chain)
    texts += [passage + [f"z{i}_{j}" for j in range(20)] for i in range(60)]
    rows = [(i, " ".join(passage[:10] + t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows, width, *threshold)
    assert found(df, width=width, threshold=threshold) == want
    classes = {c for _, c in want.values()}
    assert 4 < len(classes) < len(rows)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 400).selectExpr("id AS a", "id + 1 AS b")
    label = {r["s"]: r["root"] for r in JJ.components(edges).collect()}
    assert len(label) == 400 and len(set(label.values())) == 1
    two = JJ.components(spark.createDataFrame([(1, 2), (3, 4), (4, 5)], "a long, b long")).collect()
    assert len({r["root"] for r in two}) == 2


def test_stretches_miss_no_pair():
    import numpy as np
    rng = np.random.default_rng(3)
    for num, den in ((90, 100), (80, 100)):
        cut = JJ.Stretches(num, den)
        for n in (1, 2, 5, 9, 10, 19, 20, 57, 148, 600):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
                drop = rng.integers(0, 1 + len(a) * (den - num) // den)
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, drop + 1)).astype(np.uint64)]))
                same = len(np.intersect1d(a, b))
                if same * den >= num * (len(a) + len(b) - same):
                    assert set(cut.tokens(a).tolist()) & set(cut.tokens(b).tolist())


def test_awkward_rows(awkward, no_docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in JJ.jaccard_components(awkward).collect()}
    rows = {r["doc_id"]: r["text"] for r in awkward.collect()}
    alone = rows.pop(None)
    want = {(i, n, c) for i, (n, c) in plain(list(rows.items()), 3, 90, 100).items()}
    assert got == want | {(None, len(gram_sets([(0, alone)], 3)[0]), None)}
    assert (15, 1, 15) in got and (16, 1, 15) in got and (3, 0, 3) in got and (4, 0, 4) in got
    assert JJ.jaccard_components(awkward).count() == awkward.count()
    assert JJ.jaccard_components(no_docs).count() == 0


def test_sets_that_link_agree_without_their_most_common_tokens():
    """Each set leaves out what it can spare, by one order: a token stays common."""
    import numpy as np
    rng = np.random.default_rng(5)
    checked = spared = 0
    for num, den in ((90, 100), (80, 100)):
        cut = JJ.Stretches(num, den)
        order = lambda t: int(JJ.mix64(np.array([t], np.uint64))[0])  # noqa: E731  any order will do

        def rest(grams, j):
            tokens, free = cut.tokens_and_free(grams)
            own = sorted((t for t in tokens.tolist() if t & 1 == j), key=order)
            return set(own[:len(own) - free[j]]), free[j]

        for n in (2, 9, 20, 57, 148, 400):
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
                drop = rng.integers(0, 1 + len(a) * (den - num) // den)
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, drop + 1)).astype(np.uint64)]))
                same = len(np.intersect1d(a, b))
                if same * den >= num * (len(a) + len(b) - same):
                    sides = [(rest(a, j), rest(b, j)) for j in (0, 1)]
                    assert any(x & y for (x, _), (y, _) in sides)
                    checked += 1
                    spared += sum(f for (_, f), _ in sides)
    assert checked > 100 and spared > checked


def test_a_token_message_does_not_repeat_long_names(spark):
    """with many parts nearly every token came with 16 bytes of a set's name."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(200))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)

    def size(parts):
        sent = JJ.token_messages(df, 5, 80, 100, parts)
        return sent.selectExpr("sum(length(payload))").first()[0]

    shingler, cut = JJ.Shingler(5), JJ.Stretches(80, 100)
    tokens = sum(len(cut.tokens(shingler.of(text))) for _, text in rows)
    assert size(256) < 12 * tokens


def test_a_common_passage_asks_few_groups(spark, monkeypatch):
    """sets that share a passage and nothing else were held against each other's groups."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"o{rng.randrange(10 ** 7)}" for _ in range(90)])) for i in range(400)]
    near = rows[0][1].split()
    near[100] = "changed"
    rows.append((400, " ".join(near)))
    asked, store = [], JJ.stored
    monkeypatch.setattr(JJ, "stored", lambda df, name: (asked.append(store(df, name).count()) if name == "matrix-asks" else None) or store(df, name))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), width=5, threshold=(80, 100))
    assert got == plain(rows, 5, 80, 100) and got[400][1] == 0
    assert asked[0] < 2 * len(rows)          # 1752 when every token counted, 311 now
