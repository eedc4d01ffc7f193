"""Operator 12: certain bounds, brute force, odd rows, more than one block."""

import math

import numpy as np
import pytest

from dqlens.llm import hard_negatives as HN


def test_intervals_hold():
    rng = np.random.default_rng(5)
    for width in (1, 7, 64, 100):
        v = rng.integers(-300, 300, (200, width))
        v[:3] = 0
        v[3:6] = v[6]
        v[7] = 1 << 20
        rows = HN.RowCodes(HN.rotated(v))
        for q in v[:20]:
            middle, low, high = HN.Query(HN.rotated(q[None, :])[0]).interval(rows)
            exact = v @ q
            assert (low <= exact).all() and (exact <= high).all()


def test_rotation_keeps_products():
    v = np.random.default_rng(2).integers(-50, 50, (30, 20))
    turned = HN.rotated(v)
    assert turned.shape[1] == 64 and (turned @ turned.T == 64 * (v @ v.T)).all()


def plain(rows, every=100):
    kept = []
    for k, (i, label, v) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((k, i, label, [max(-(1 << 20), min(1 << 20, math.floor(256 * x))) if abs(x) < 1e6 else int(math.copysign(1 << 20, x)) for x in v]))
    first = lambda found: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))[:5]
    out = []
    for k, i, label, q in kept:
        if i is None or i % every:
            continue
        score = {kk: sum(x * y for x, y in zip(v, q)) for kk, _, _, v in kept}
        for ps, pid, _ in first([(score[kk], ii, kk) for kk, ii, ll, _ in kept if ll == label and kk != k]):
            found = first([(score[kk], ii, kk) for kk, ii, ll, _ in kept if ll != label and 80 * ps <= 100 * score[kk] <= 100 * ps])
            out += [(i, pid, r + 1, ii, ps, ns) for r, (ns, ii, _) in enumerate(found)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 0, 0, True) for r in rows],
                                 "vec_id long, label int, embedding array<double>, row int, tie int, v string, a int, b int, anchor boolean")


def made(n, seed, labels=4, width=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, width))
    return [(i, int(rng.integers(labels)), (centre[i % 3] + 0.3 * rng.normal(size=width)).tolist()) for i in range(n)]


ODD = [(100, 1, [0.5] * 12), (100, 1, [0.5] * 12), (100, 2, [0.25] * 12), (None, 1, [0.5] * 12), (None, 2, [0.45] * 12), (200, None, [0.1] * 12),
       (300, 1, None), (400, 1, [0.1, None]), (500, 1, [float("nan")] * 12), (600, 1, [float("-inf")]), (700, 3, []), (800, 1, [0.4, 0.5]),
       (900, 2, [1e30, -1e30]), (1000, 2, [-0.5] * 12), (-100, -3, [0.45] * 12), (1, 2, [0.0] * 12)]


@pytest.mark.parametrize("rows", [made(250, 3), ODD, ODD + made(120, 4), made(40, 6, labels=1)])
def test_brute_force(spark, rows):
    got = HN.hard_negatives(table(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(rows)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(HN, "ROWS", 40)
    monkeypatch.setattr(HN, "QUERIES", 3)
    rows = made(300, 8) + ODD
    got = HN.hard_negatives(table(spark, rows), lambda c: c % 20 == 0).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(rows, 20)


def test_no_rows(spark):
    assert HN.hard_negatives(table(spark, ODD).where("false")).collect() == []
