"""Signatures of token sets: similar sets share enough, whatever their sizes."""

from __future__ import annotations

import numpy as np

from tollgate.operators import neardup


def both_schemes(sets):
    """For each set its signatures in the scheme of its class and of the next one."""
    out = []
    for up in (0, 1):
        sigs, n = neardup.signatures(np.concatenate(sets), [len(s) for s in sets], up)
        out.append([set(x.tolist()) for x in np.split(sigs, np.cumsum(n)[:-1])])
    return out


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    sets, pairs = [], []
    for size in [*range(5, 120), 333, 1000, 4000]:
        for _ in range(6):
            a = rng.integers(-(1 << 62), 1 << 62, size)
            # as many tokens left out and put in as the threshold bears
            out = int(rng.integers(0, size // 5 + 1))
            b = a[out:]
            while (len(b) + 1 - (size - out)) + size <= (size - out) * 100 // 82 and rng.random() < .9:
                b = np.append(b, rng.integers(-(1 << 62), 1 << 62))
            inter, union = size - out, size + len(b) - (size - out)
            if len(b) >= 5 and 100 * inter >= 82 * union:
                pairs.append((len(sets), len(sets) + 1))
                sets += [a, rng.permutation(b)]
    assert len(pairs) > 300
    own, above = both_schemes(sets)
    bounds = np.array(neardup.BOUNDS)
    level = [int(np.searchsorted(bounds, len(s), side="right")) for s in sets]
    for a, b in pairs:
        assert abs(level[a] - level[b]) <= 1
        if level[a] > level[b]:
            a, b = b, a
        differ = 2 * (neardup.BOUNDS[level[b]] - 1) * 18 // 182
        assert len((own[a] if level[a] == level[b] else above[a]) & own[b]) >= 1 + min(differ // 2, neardup.EXTRA)


def test_unlike_sets_of_frequent_words_do_not_meet():
    """300 sets of 4,000 words: every word has a list, and no signature has."""
    rng = np.random.default_rng(6)
    words = rng.integers(-(1 << 62), 1 << 62, 4000)
    sets = [rng.permutation(words)[:180] for _ in range(300)]
    own, _ = both_schemes(sets)
    shared = sum(len(own[a] & own[b]) > neardup.EXTRA for a in range(300) for b in range(a))
    assert shared == 0


def test_long_and_short_lists_give_every_pair_once(spark, monkeypatch):
    """With lists that count as long from 32 rows on, pairs come from both ways."""
    from conftest import frame
    from tollgate.config import Roles
    from tollgate.operators.prepare import prepare

    rng = np.random.default_rng(7)
    rows = []
    for g in range(6):
        base = [f"g{g}w{j}" for j in range(40 + 3 * g)]
        for _ in range(70 if g < 2 else 5):
            keep = [w for w in base if rng.random() > .06]
            rows.append(" ".join(keep + [f"x{rng.integers(1 << 30)}" for _ in range(rng.integers(0, 4))]))
    sets = [set(r.split()) for r in rows]
    want = sum(a != b and 100 * len(a & b) >= 82 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    df = frame(spark, [{"id": str(i), "text": r} for i, r in enumerate(rows)])
    got = []
    for dense in (32, 256):
        monkeypatch.setattr(neardup, "DENSE", dense)
        p = prepare(df, release_id="r", roles=Roles(id="id"), order_by=[df["__seq"]])
        got.append((neardup.near_pairs(p).first().pairs, neardup._dense(p)[1] > 0))
    assert got == [(want, True), (want, False)] and want > 500


def test_slices_give_every_pair_and_read_few_texts(spark, monkeypatch):
    """Candidates and long lists are compared in slices, whatever their number with one result, and
    evidence compares only sets beside the first ones."""
    from conftest import frame
    from tollgate.config import Roles
    from tollgate.operators.prepare import prepare

    rng = np.random.default_rng(8)
    rows = []
    for g in range(60):
        base = [f"g{g}w{j}" for j in range(30 + g)]
        for _ in range(50 if g < 2 else 3):
            rows.append(" ".join([w for w in base if rng.random() > .05] + [f"x{rng.integers(1 << 30)}"]))
    sets = [set(r.split()) for r in rows]
    similar = [(b + 1, a + 1) for a, x in enumerate(sets) for b, y in enumerate(sets[:a])
               if x != y and 100 * len(x & y) >= 82 * len(x | y)]
    df = frame(spark, [{"id": str(i), "text": r} for i, r in enumerate(rows)])
    monkeypatch.setattr(neardup, "DENSE", 32)
    for size in (20, 1000):
        monkeypatch.setattr(neardup, "SLICE_SETS", size)
        monkeypatch.setattr(neardup, "DENSE_SETS", size)
        p = prepare(df, release_id="r", roles=Roles(id="id"), order_by=[df["__seq"]])
        assert neardup.near_pairs(p).first().pairs == len(similar)
        shown = [(r.row, r.other_row) for r in neardup.near_evidence(p).orderBy("ordinal").collect()]
        assert shown == sorted(similar)[:6]
        assert sum(name.startswith("near_compared:") for name in p._memo) == (8 if size == 20 else 1)
        beside = p._memo["near_beside_places:6"].count()
        assert beside < len(rows) // 2


def test_pairs_of_lists_are_counted_in_slices(monkeypatch):
    """Lists are cut from batches wherever these end; each pair of a list is counted once, in one slice."""
    from collections import Counter

    import pyarrow as pa

    rng = np.random.default_rng(9)
    lists, rows = [], []
    for tok in range(300):
        release = None if tok % 7 == 0 else f"r{tok % 2}"
        members = sorted(rng.choice(40, int(rng.integers(1, 12)), replace=False).tolist())
        held = [(s, 50 + s % 17, bool(rng.random() < .4)) for s in members]
        lists.append((release, held))
        rows += [(release, tok, *x) for x in held]
    want = Counter()
    for release, held in lists:
        for i, (a, ka, ua) in enumerate(held):
            for b, kb, ub in held[i + 1:]:
                if not (ua and ub) and 100 * min(ka, kb) >= 82 * max(ka, kb):
                    want[release, a, b, ua, ub] += 1
    table = pa.table({"release_id": pa.array([r[0] for r in rows], pa.string()), "tok": pa.array([r[1] for r in rows], pa.int64()),
                      "s": pa.array([r[2] for r in rows], pa.int64()), "k": pa.array([r[3] for r in rows], pa.int32()),
                      "up": pa.array([r[4] for r in rows])})
    for size, at_once in ((3, 5), (1000, 1 << 20)):
        monkeypatch.setattr(neardup, "PAIRS_AT_ONCE", at_once)
        made = pa.Table.from_batches(list(neardup._lists(table.to_batches(max_chunksize=size))))
        assert made.num_rows == sum(len(held) > 1 and not all(u for _, _, u in held) for _, held in lists)
        made = made.append_column("need", pa.array([4] * made.num_rows, pa.int32())).sort_by([("release_id", "ascending")])
        got, places = Counter(), Counter()
        for which in range(3):
            slice_of = Counter()
            for batch in neardup.list_pairs(made.to_batches(max_chunksize=50), which, 3):
                for r in batch.to_pylist():
                    assert r["need"] == 4
                    slice_of[r["release_id"], r["sa"], r["sb"], r["ua"], r["ub"]] += r["shared"]
            got += slice_of
            places.update({x[1] for x in slice_of})
        assert got == want and set(places.values()) == {1}


def test_lists_of_one_set_are_dropped(spark, monkeypatch):
    """Signatures are sorted into lists a slice at a time, with one result, and few are kept."""
    from conftest import frame
    from tollgate.config import Roles
    from tollgate.operators.prepare import prepare

    rng = np.random.default_rng(10)
    rows = [" ".join(f"g{g}w{j}" for j in range(40 + g % 9) if c == 0 or rng.random() > .05) for g in range(60) for c in range(1 + 3 * (g < 10))]
    sets = [set(r.split()) for r in rows]
    want = sum(a != b and 100 * len(a & b) >= 82 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    df = frame(spark, [{"id": str(i), "text": r} for i, r in enumerate(rows)])
    for size, slices in ((20, 5), (1000, 1)):
        monkeypatch.setattr(neardup, "LIST_SETS", size)
        p = prepare(df, release_id="r", roles=Roles(id="id"), order_by=[df["__seq"]])
        assert neardup.near_pairs(p).first().pairs == want > 20
        for name in ("near_lists:", "near_candidates:"):
            assert sum(x.startswith(name) for x in p._memo) == slices
        kept = sum(len(r.s) for r in neardup._short_lists(p).collect())
        assert kept < neardup._places(neardup.signed_sets(p)).count() // 2


def test_texts_are_signed_in_slices(spark, monkeypatch):
    """The texts of the sets travel a slice at a time, with the same signatures whatever their number."""
    from conftest import frame
    from tollgate.config import Roles
    from tollgate.operators.prepare import prepare

    df = frame(spark, [{"id": str(i), "text": " ".join(f"g{i % 90}w{j}" for j in range(8 + i % 90))} for i in range(100)])
    signed = []
    for size, slices in ((20, 5), (1000, 1)):
        monkeypatch.setattr(neardup, "LIST_SETS", size)
        p = prepare(df, release_id="r", roles=Roles(id="id"), order_by=[df["__seq"]])
        signed.append(sorted((r.s, r.k, tuple(r.own), tuple(r.above)) for r in neardup.signed_sets(p).collect()))
        kept = [v for name, v in p._memo.items() if name.startswith("near_signed")]
        assert len(kept) == slices and all(f.count() < 90 for f in kept) == (slices > 1)
    assert signed[0] == signed[1] and len(signed[0]) == 90
