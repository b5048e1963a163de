"""Texts travel as they are: their tokens are hashed where they are compared, and few slices read them."""

from __future__ import annotations

import itertools
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tollgate.operators import neardup


def texts_of(rnd, n):
    letters = "abcdefghij0123456789éßжのあ漢"
    return [" ".join(sorted({"".join(rnd.choices(letters, k=rnd.choice((1, 2, 3, 5, 8, 300)))) for _ in range(rnd.randrange(5, 40))}))
            for _ in range(n)]


def test_token_ids_name_tokens_wherever_they_stand(monkeypatch):
    texts = texts_of(random.Random(1), 200)
    words = [t.split(" ") for t in texts]
    for at_once in (50, 1 << 17):
        monkeypatch.setattr(neardup, "BYTES_AT_ONCE", at_once)
        monkeypatch.setattr(neardup, "_POWERS", {})
        for held in (pa.array(texts), pa.array(["before", *texts]).slice(1), pa.array(texts, pa.large_string())):
            ids, counts = neardup.token_ids(held)
            assert counts.tolist() == [len(w) for w in words]
            named = set(zip(itertools.chain(*words), ids.tolist()))
            assert len(named) == len({w for w, _ in named}) == len({i for _, i in named})
    assert neardup.token_ids(pa.array([], pa.string()))[0].tolist() == []


def test_pairs_are_compared_by_their_texts():
    rnd = random.Random(2)
    texts = [" ".join(sorted(rnd.sample([f"w{i}" for i in range(60)], rnd.randrange(5, 50)))) for _ in range(30)]
    places = rnd.sample(range(1 << 40), 30)
    pairs = [(a, b) for a in range(30) for b in range(30) if a != b and rnd.random() < .3]
    columns = {"release_id": ["r"] * len(pairs), **{c: [0] * len(pairs) for c in ("sa", "sb", "ma", "mb", "a_key", "b_key", "ka", "kb")},
               "pa": [places[a] for a, _ in pairs], "pb": [places[b] for _, b in pairs]}
    got = neardup.compare_pairs(pa.table(columns), pa.table({"place": places, "token_text": texts}))
    assert got.column("inter").to_pylist() == [len(set(texts[a].split()) & set(texts[b].split())) for a, b in pairs]


def test_products_of_one_side_leave_out_what_one_array_holds():
    rng = np.random.default_rng(3)
    rows = [rng.choice(300, 40, replace=False) + 1000 * (i % 3) for i in range(12)]
    got = neardup._products(rows, rows, True)
    assert all(got[a, b] == len(set(rows[a].tolist()) & set(rows[b].tolist())) for a in range(12) for b in range(12) if a != b)


def test_texts_of_a_gigabyte_are_read_a_few_times():
    """Signing, lists and candidates once for the sets of 0.5 GB; comparisons three times."""
    prep = SimpleNamespace(counts={"near_sets": 249_789}, memo=lambda name, *a, **k: None, df=None)
    assert neardup._list_slices(prep) == 1
    assert min(neardup.SLICES, 1 + 249_789 // neardup.SLICE_SETS) <= 3


def test_pairs_that_met_before_are_not_compared_again(monkeypatch):
    """Of a unit whose pairs share an earlier signature no token is hashed."""
    n = 20
    table = pa.table({"s": pa.array(range(n), pa.int64()), "m": pa.array([1] * n, pa.int64()), "set_key": pa.array([bytes([i]) for i in range(n)], pa.binary()),
                      "k": pa.array([6] * n, pa.int32()), "pos": pa.array([1] * n, pa.int32()), "own": pa.array([0] * n, pa.int32()),
                      "left": pa.array([True] * n), "up": pa.array([False] * n), "sigs": pa.array([[7, 8]] * n, pa.list_(pa.int64())),
                      "token_text": pa.array(["a b c d e f"] * n)})
    key = [pa.scalar(v) for v in ("r", 8, 0, 0)]
    monkeypatch.setattr(neardup, "token_ids", None)
    assert neardup.compare_unit(key, table).num_rows == 0
    monkeypatch.undo()
    first = table.set_column(4, "pos", pa.array([0] * n, pa.int32()))
    assert neardup.compare_unit([pa.scalar(v) for v in ("r", 7, 0, 0)], first).num_rows == n * (n - 1) // 2


def test_signatures_do_not_depend_on_the_batch():
    """Parts of equal size and hash beginnings are taken in one order, whatever stands beside the set."""
    rng = np.random.default_rng(4)
    sets = [rng.integers(-(1 << 62), 1 << 62, n) for n in (5, 40, 300, 9000, 40, 6)]
    for up in (0, 1):
        sigs, n = neardup.signatures(np.concatenate(sets), [len(x) for x in sets], up)
        for x, own in zip(sets, np.split(sigs, np.cumsum(n)[:-1])):
            assert neardup.signatures(rng.permutation(x), [len(x)], up)[0].tolist() == own.tolist()


def test_few_common_elements_make_narrow_matrices(monkeypatch):
    widths, zeros = [], np.zeros
    monkeypatch.setattr(np, "zeros", lambda shape, *a: (widths.append(shape[1]) if isinstance(shape, tuple) else None, zeros(shape, *a))[1])
    rows = [np.array([1, 2, i]) for i in range(10, 14)]
    assert neardup._products(rows, rows, True)[0, 1] == 2 and max(widths) == 4
