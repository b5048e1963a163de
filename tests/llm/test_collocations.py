"""Collocations against a plain count, and the summaries' guarantee."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tollgate.llm import collocations

from test_operators import docs  # noqa: F401


def brute(rows, least=10, cover=50, keep=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        found = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[k : k + len(p)] == p for k in range(len(q)))
                   for q, b in kept.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_awkward_table(spark, docs):  # noqa: F811
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = brute(rows)
    assert got(collocations.collocations(docs)) == want and want
    assert collocations.collocations(docs.limit(0)).collect() == []


@pytest.mark.parametrize("mass, bits", [(16_000_000, 27), (60, 27), (300, 4)])
def test_random_tables(spark, monkeypatch, mass, bits):
    """Many partitions, flushes and rows of summaries; a full bit map; ties; hot words; nulls."""
    rnd = random.Random(mass)
    monkeypatch.setattr(collocations, "BITS", bits)
    flush = 40 if mass < 1000 else collocations.FLUSH
    words = ["a", "B", "b", "ç", "x-y", "\x1c", "漢字", "d'e", "f", "g", "\U0001f600"]
    rows = [(rnd.choice(["en", None, "und", "fr"]),
             rnd.choice([None, ""]) if rnd.random() < .05 else
             "".join(rnd.choices(words, [9, 3, 3, 2, 2, 1, 1, 1, 1, 1, 1])[0] + rnd.choice([" ", " ", " ", "\t", ", ", "\n", "  ", ";"])
                     for _ in range(rnd.randrange(40)))) for _ in range(150)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, phrase int, part string").repartition(5)
    assert got(collocations.collocations(df, mass=mass, flush=flush)) == brute(rows)
    assert got(collocations.collocations(df, keep=3, mass=mass, flush=flush)) == brute(rows, keep=3)


def test_frequent_phrases_keep_a_counter():
    """Any order of merges: what occurs ``least`` times survives, and no more than the capacity does."""
    rnd = np.random.default_rng(3)
    for least in (3, 10):
        stream = np.concatenate([np.repeat(np.arange(30), least), rnd.integers(100, 100_000, 6000)])
        rnd.shuffle(stream)
        summary = collocations.Summary(len(stream) // least + 1)
        for part in np.array_split(stream, 70):
            h, c = np.unique(part, return_counts=True)
            summary.add(h.astype(np.uint32), c)
            summary.merge()
        assert set(range(30)) <= set(summary.h.tolist()) and len(summary.h) <= summary.capacity
        assert 0 < summary.taken < least


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "STRETCH", 7)
    text = b"a bb ccc\xffdd e\xfff g h i j k l m n o p\xff\xffq"
    parts = list(collocations.stretches(text))
    assert b"".join(parts) == text and len(parts) > 2 and all(p.endswith(b"\xff") for p in parts[:-1])
    assert list(collocations.stretches(b"")) == [b""]


def test_many_words_do_not_overflow():
    """Word numbers too large for three in 64 bits."""
    seen = collocations.Occurrences()
    seen.number.update((b"w%d" % k, k) for k in range(1, 3_000_000))
    seen.ids["en"].append(np.array([2_999_997, 2_999_998, 2_999_999, 0, 2_999_997, 2_999_998, 2_999_999, 0]))
    collocations_hash, collocations.word_hash = collocations.word_hash, lambda w: 7
    try:
        found = [(n, c.tolist()) for _, n, _, c, _ in seen.counted([], range(1, 4))]
    finally:
        collocations.word_hash = collocations_hash
    assert found == [(1, [2, 2, 2]), (2, [2, 2]), (3, [2])]
