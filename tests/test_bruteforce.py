"""Randomised tables checked against the definitions in naive.py:
counts and evidence of exact duplicates, near duplicates, split leakage and conflicting labels, and invariance under
repartitioning."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import naive
from conftest import frame, ordered
from tollgate import Limits, Roles
from tollgate.operators import duplicates, labels, leakage, neardup
from tollgate.operators.prepare import prepare

ROLES = Roles(label="label", split="split", id="id")
ROLE_DICT = {"label": "label", "split": "split", "id": "id"}


def random_rows(seed: int, n: int):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(rnd.choice([8, 12, 20]))]
    bases = [[rnd.choice(vocab) for _ in range(rnd.randint(3, 12))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2])):  # small edits keep near copies
            pos = rnd.randrange(len(words))
            words[pos] = rnd.choice(vocab)
        if rnd.random() < 0.2:
            words.append(rnd.choice(vocab))
        text = " ".join(words)
        if rnd.random() < 0.1:
            text = "  " + text.upper() + " "  # same after normalisation
        rows.append({
            "id": f"R{i}",
            "text": text,
            "extra": rnd.choice(["a b", "c", None]),
            "label": rnd.choice(["x", "y", None, "X "]),
            "split": rnd.choice(["train", "test", "", None, "val"]),
        })
    return rows


def _prep(spark, rows, limits=Limits(), parts=None):
    df = frame(spark, rows, ["id", "text", "extra", "label", "split"])
    if parts:
        df = df.repartition(parts)
    return prepare(df, release_id="r", roles=ROLES, limits=limits, order_by=[F.col("__seq")])


def _pairs(df):
    return sorted((r.row, r.other_row) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_detectors_equal_brute_force(spark, seed):
    rows = random_rows(seed, 90)
    p = _prep(spark, rows)
    # exact duplicates
    pairs, ev = naive.exact(rows, ROLE_DICT)
    got = duplicates.exact_pairs(p).collect()
    assert (got[0].pairs if got else 0) == pairs
    assert [(r.row, r.other_row) for r in duplicates.exact_evidence(p).orderBy("ordinal").collect()] == ev
    # near duplicates
    npairs, nev = naive.near(rows, ROLE_DICT)
    got = neardup.near_pairs(p).collect()
    assert (got[0].pairs if got else 0) == npairs
    assert [(r.row, r.other_row) for r in neardup.near_evidence(p).orderBy("ordinal").collect()] == nev
    # leakage
    lpairs, lev = naive.leakage(rows, ROLE_DICT)
    got = leakage.leakage_pairs(p).collect()
    assert (got[0].pairs if got else 0) == lpairs
    assert [(r.row, r.other_row) for r in leakage.leakage_evidence(p).orderBy("ordinal").collect()] == lev
    # conflicts
    cn, cev = naive.conflicts(rows, ROLE_DICT)
    got = labels.conflicting_labels(p).collect()
    assert (got[0].groups if got else 0) == cn
    assert [(r.row, r.other_row) for r in labels.conflict_evidence(p).orderBy("ordinal").collect()] == cev


def test_repartition_invariance(spark):
    rows = random_rows(11, 120)
    results = []
    for parts in (1, 3, 7):
        p = _prep(spark, rows, parts=parts)
        results.append((
            neardup.near_pairs(p).first().pairs,
            _pairs(neardup.near_evidence(p)),
            duplicates.exact_pairs(p).first().pairs,
            sorted(r._row for r in p.df.select("_row").collect()),
        ))
    assert results[0] == results[1] == results[2]
    assert results[0][3] == list(range(120))


def test_hot_cluster_counts_without_enumeration(spark):
    """A third of the rows share one token set (with two fingerprints):
    counted from multiplicities, not from enumerated pairs."""
    base = "alpha beta gamma delta epsilon zeta eta theta"
    rows = []
    for i in range(150):
        if i % 3 == 0:
            text = base if i % 2 == 0 else base.upper() + " ."  # same tokens, other text
        else:
            text = f"t{i} u{i} v{i} w{i} x{i} y{i}"
        rows.append({"id": f"H{i}", "text": text, "extra": None, "label": "a", "split": "train"})
    p = _prep(spark, rows)
    npairs, nev = naive.near(rows, ROLE_DICT)
    assert neardup.near_pairs(p).first().pairs == npairs
    assert [(r.row, r.other_row) for r in neardup.near_evidence(p).orderBy("ordinal").collect()] == nev


def test_results_survive_cache_loss(spark):
    """Cached blocks can vanish with an executor; recomputation from the
    checkpoints must give the same rows and numbers."""
    rows = random_rows(12, 80)
    p = _prep(spark, rows)
    before = (neardup.near_pairs(p).first().pairs, _pairs(neardup.near_evidence(p)),
              sorted(tuple(r) for r in p.df.select("_row", "fp_exact").collect()))
    spark.catalog.clearCache()
    after = (neardup.near_pairs(p).first().pairs, _pairs(neardup.near_evidence(p)),
             sorted(tuple(r) for r in p.df.select("_row", "fp_exact").collect()))
    assert before == after


def test_near_identical_rows_store_no_pairs(spark):
    """1,500 rows that all resemble each other: 1.1 million pairs are counted, and
    nothing kept is larger than the table."""
    common = " ".join(f"shared{i}" for i in range(60))
    rows = [{"id": f"n{i}", "text": f"{common} own{i}", "extra": None, "label": "a", "split": "train"} for i in range(1500)]
    p = _prep(spark, rows)
    assert neardup.near_pairs(p).first().pairs == 1500 * 1499 // 2
    assert _pairs(neardup.near_evidence(p)) == [(1, k) for k in range(2, 8)]
    kept = [f for v in p._memo.values() for f in (v if isinstance(v, tuple) else (v,))]
    assert max(f.count() for f in kept) <= 1500


def test_whole_texts_decide(spark):
    """Rows that agree in their first 200 words and not beyond are no near copies."""
    head = " ".join(f"head{i}" for i in range(200))
    rows = [{"id": str(i), "text": head + " " + " ".join(f"tail{i}x{j}" for j in range(200)), "extra": None,
             "label": "a", "split": "train"} for i in range(2)]
    assert neardup.near_pairs(_prep(spark, rows)).first().pairs == 0
    rows[1]["text"] = rows[0]["text"] + " more"
    assert neardup.near_pairs(_prep(spark, rows)).first().pairs == 1
