"""Hard negatives against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tollgate.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=10, low=30, high=90, every=100):
    clean = {(i, l, tuple(v)) for i, l, v in rows if i is not None and l is not None and v is not None
             and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)}
    scaled = [(i, l, [math.floor(256 * x) for x in v], v) for i, l, v in clean]
    out = Counter()
    for a in scaled:
        if a[0] % every:
            continue
        met = [(-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a[2], b[2])))), b[0], b[1]) for b in scaled if b is not a and len(b[2]) == len(a[2])]
        best = sorted(r for r in met if r[2] == a[1])[:positives]
        for s, i, _ in best:
            window = sorted(r for r in met if r[2] != a[1] and -low * s <= -100 * r[0] <= -high * s)[:negatives]
            out.update((a[0], i, k, n[1], -s, -n[0]) for k, n in enumerate(window, 1))
    return out


def got(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows],
                                 "vec_id long, label int, embedding array<double>, tile int, mark string").repartition(3)


@pytest.mark.parametrize("d", [1, 2, 6])
def test_random_rows(spark, d):
    """Coarse values make ties and empty windows; several tiles and blocks."""
    rnd = random.Random(d)
    rows = [(i, rnd.randrange(3), [rnd.choice((-1.0, -.25, 0.0, .5, .75, 1.0)) for _ in range(d)]) for i in range(240)]
    rows += rows[:40]
    want = brute(rows, every=20)
    assert got(hn.mine(table(spark, rows), every=20, tile=50, block=5)) == want and want


def test_awkward_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [1.0, 1.0]), (1, 1, [1.0, 0.0]), (2, 1, [1.0]), (3, 1, []), (100, 1, []),
            (4, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (5, 1, None), (6, 1, [None, 1.0]), (7, 1, [nan, 1.0]), (8, 1, [inf, 1.0]),
            (9, 2, [.5, .5]), (10, 2, [.6, .3]), (11, 3, [.5, .25]), (200, 3, [1e6, 1.0]), (201, 3, [1e6, 2.0]), (202, 1, [5e5, 1.0]),
            (203, 1, [1e307, 0.0]), (204, 2, []), (-100, 2, [-1.0, -1.0]), (-7, 2, [-.5, -1.0]), (-8, 3, [-.4, -.4])]
    want = brute(rows)
    assert got(hn.mine(table(spark, rows))) == want and {k[0] for k in want} >= {0, 200, -100, 100}
    assert hn.mine(table(spark, rows).limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    rows = [(100, 1, [1e20, 1.0]), (1, 1, [1e20, 0.0]), (3, 1, [1e19, 0.0]), (4, 1, [1.0, 0.0]), (2, 2, [1e19, 0.0]),
            (5, 2, [.5, 0.0]), (6, 2, [.2, 9.0]), (300, 1, [-1e20, 1.0])]
    assert got(hn.mine(table(spark, rows))) == brute(rows)


def test_label_moves(spark):
    rows = [(7, 9, [1.0]), (14, 0, [1.0]), (15, 9, [1.0]), (0, None, [1.0])]
    assert {r.vec_id: r.label for r in hn.relabelled(table(spark, rows)).collect()} == {7: 0, 14: 1, 15: 9, 0: None}


def test_tree_search_prunes_and_finds_all():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.standard_normal((5000, 3)))
    ids, marks = np.arange(5000), np.zeros(5000, np.int64)
    tree = hn.Tree(x, ids, marks, 16, 4)
    assert sorted(i for _, i, _ in tree.leaves for i in i.tolist()) == list(range(5000))
    read = 0

    class Counted(list):
        def __getitem__(self, k):
            nonlocal read
            read += 1
            return super().__getitem__(k)

    n = len(tree.leaves)
    tree.leaves = Counted(tree.leaves)
    for q in np.floor(256 * rng.standard_normal((20, 3))):
        s = x @ q
        top = np.sort(s)[-1]
        for low, high in ((-math.inf, math.inf), (0.3 * top, 0.9 * top), (10, 10), (top + 1, math.inf)):
            best = hn.Best(low, high, 7)
            hn.search([tree], q, [best])
            at = np.flatnonzero((s >= low) & (s <= high))
            assert best.rows == sorted((-s[k], k, 0) for k in at)[:7]
    assert read < 0.25 * 80 * n
