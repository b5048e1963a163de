"""Blocks of dense lists: every similar pair once, whatever the blocks."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tollgate.operators import neardup


def similar(a, b):
    inter = len(set(a) & set(b))
    return 100 * inter >= 82 * (len(a) + len(b) - inter)


def prefix(k):
    return k - (k * 82 + 99) // 100 + 1


def test_units_find_every_pair_once():
    rnd = random.Random(8)
    common = list(range(100, 130))
    sets = []
    for _ in range(70):
        kept = [t for t in common if rnd.random() < rnd.choice((.95, .8))]
        sets.append(sorted(set(kept + [rnd.randrange(100) for _ in range(rnd.randrange(4))])))  # rare tokens come first
    mult = [rnd.randrange(1, 4) for _ in sets]
    want = {(x, y) for x in range(70) for y in range(x + 1, 70) if similar(sets[x], sets[y])}
    assert len(want) > 50
    found, sums = Counter(), Counter()
    for token in range(130):
        members = [(s, ids.index(token)) for s, ids in enumerate(sets) if token in ids[: prefix(len(ids))]]
        g = 1 + len(members) // 9
        own = {s: rnd.randrange(g) for s, _ in members}
        for i in range(g):
            for j in range(i, g):
                rows = [(s, p) for s, p in members if own[s] in (i, j)]
                if not rows:
                    continue
                table = pa.table({
                    "s": pa.array([s for s, _ in rows], pa.int64()), "m": pa.array([mult[s] for s, _ in rows], pa.int64()),
                    "set_key": pa.array([bytes([s]) for s, _ in rows], pa.binary()), "k": pa.array([len(sets[s]) for s, _ in rows], pa.int32()),
                    "pos": pa.array([p for _, p in rows], pa.int32()), "own": pa.array([own[s] for s, _ in rows], pa.int32()),
                    "left": pa.array([True] * len(rows)), "ids": pa.array([sets[s] for s, _ in rows], pa.list_(pa.int64()))})
                key = [pa.scalar(v) for v in ("r", token, i, j)]
                got = neardup.compare_unit(key, table).to_pylist()
                for r in got:
                    assert (r["inter"], r["ka"], r["kb"]) == (len(set(sets[r["sa"]]) & set(sets[r["sb"]])), len(sets[r["sa"]]), len(sets[r["sb"]]))
                    assert (r["ma"], r["mb"], r["a_key"], r["b_key"]) == (mult[r["sa"]], mult[r["sb"]], bytes([r["sa"]]), bytes([r["sb"]]))
                found.update((r["sa"], r["sb"]) for r in got)
                assert [(r["sa"], r["sb"]) for r in neardup.compare_unit(key, table, 2).to_pylist()] == sorted((r["sa"], r["sb"]) for r in got)[:2] or len(got) <= 2
                for r in neardup.compare_unit(key, table, sums=True).to_pylist():
                    sums[r["sa"]] += int(r["pairs"])
    assert set(found) == want and set(found.values()) == {1}
    assert sums == Counter({x: sum(mult[x] * mult[y] for a, y in want if a == x) for x in {x for x, _ in want}})


def test_products_over_many_elements():
    rng = np.random.default_rng(1)
    rows = [rng.choice(20_000, 3000, replace=False) for _ in range(4)]
    cols = [rng.choice(20_000, 5000, replace=False) for _ in range(3)] + [np.zeros(0, np.int64)]
    got = neardup._products(rows, cols)
    assert got.tolist() == [[len(set(r.tolist()) & set(c.tolist())) for c in cols] for r in rows]
