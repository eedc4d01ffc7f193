"""Operator 13: exact products, the plain form of the codes, odd rows."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dqlens.llm import vector_codes as VC


@given(st.integers(0, 40), st.integers(1, 31), st.integers(0, 2 ** 32))
@settings(max_examples=60, deadline=None)
def test_products_are_exact(width, bits, seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(-(1 << bits) + 1, 1 << bits, (5, width)) for _ in range(2))
    if bits > 29:
        a, b = a >> 3, b >> 3
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert VC.exact_dots(a, b).tolist() == want


def test_products_beyond_float64():
    a = np.array([[(1 << 40) + 1, -(1 << 40) + 3]], np.int64)
    b = np.array([[(1 << 20) + 7, (1 << 20) - 5]], np.int64)
    assert VC.exact_dots(a, b)[0, 0] == ((1 << 40) + 1) * ((1 << 20) + 7) + (3 - (1 << 40)) * ((1 << 20) - 5)


def plain(rows, parts=8, entries=16, rounds=6):
    """rows: (id, label, floats); all in Python integers."""
    kept = []
    for i, label, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [max(-(1 << 23), min(1 << 23, math.floor(4096 * x))) if abs(x) < 1e6 else int(math.copysign(1 << 23, x)) for x in v]))
    length = -(-max((len(v) for *_, v in kept), default=0) // parts) * parts
    kept = [(i, label, v + [0] * (length - len(v))) for i, label, v in kept]
    w = length // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[v[p * w:p * w + w] for *_, v in first] for p in range(parts)]

    def near(p, v):
        gaps = [sum((x - y) ** 2 for x, y in zip(v[p * w:p * w + w], c, strict=True)) for c in books[p]]
        return gaps.index(min(gaps)), min(gaps)
    for _ in range(rounds):
        won = [[near(p, v)[0] for *_, v in kept] for p in range(parts)]
        new = [[list(c) for c in b] for b in books]
        for p in range(parts):
            for e in range(len(first)):
                mine = [kept[k][2] for k in range(len(kept)) if won[p][k] == e]
                if mine:
                    new[p][e] = [sum(v[p * w + j] for v in mine) // len(mine) for j in range(w)]
        books = new
    out = []
    for i, label, v in kept:
        found = [near(p, v) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for e, _ in found), sum(g for _, g in found)))
    total = {}
    for _, label, _, gap in out:
        total[label] = total.get(label, 0) + gap
    return sorted([(*r, total[r[1]]) for r in out], key=str), books


ROWS = [(3, 1, [0.5, -0.25, 0.1, 0.9, 0.0, 0.0, 1.5, 2.5, -1.0, 0.3]), (1, None, [0.1] * 10), (1, None, [0.1] * 10),
        (None, 2, [-0.7] * 10), (2, 2, None), (4, 2, [0.1, None]), (5, 2, [float("nan")] * 10), (6, 1, [float("inf")] * 10),
        (7, 1, []), (8, 1, [0.3, -0.4]), (9, None, [1e30, -1e30] * 5), (1, 1, [0.2] * 10)] + [
        (20 + k, k % 3, [math.sin(k * j + 1) for j in range(10)]) for k in range(25)]


def table(spark, rows):
    extra = [(*r, "c", 1, 2, "v", 0, "b") for r in rows]
    return spark.createDataFrame(extra, "vec_id long, label int, embedding array<double>, code string, error int, id int, "
                                        "v string, part int, of string")


def result(df):
    return sorted([(r["id"], r["label"], r["code"], r["error"], r["label_error"]) for r in df.collect()], key=str)


def test_awkward_rows(spark):
    got, books = VC.compress(table(spark, ROWS))
    want, plain_books = plain(ROWS)
    assert result(got) == want and books.tolist() == plain_books


def test_few_rows_and_none(spark):
    got, books = VC.compress(table(spark, ROWS[:5]))
    want, plain_books = plain(ROWS[:5])
    assert result(got) == want and books.tolist() == plain_books
    got, books = VC.compress(table(spark, ROWS[4:7]))
    assert result(got) == [] and books.shape == (8, 0, 0)
    got, _ = VC.compress(table(spark, [(1, 1, []), (2, None, [])]))
    assert result(got) == [(1, 1, "00" * 8, 0, 0), (2, None, "00" * 8, 0, 0)]
