"""Each pipeline stage on repeated and null ids, empty tables and clashing names."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tollgate.llm import langid_kn, packing, pii_gbt, spaced_seeds

EN = "the house and the river are in the old town and the people walk along the water "
DE = "das haus und der fluss sind in der alten stadt und die leute gehen am wasser entlang "
ITEM = "which of these seven planets is the one that lies closest to the sun"


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    texts = [(k, EN + str(k) + " more", "en") for k in range(30)] + [(100 + k, DE + str(k) + " mehr", "de") for k in range(30)]
    texts += [(1, EN + "1 more", "en"), (1, EN + "1 more", "en"), (None, EN + "none", None), (None, EN + "none", None), (None, DE, "de"),
              (5, None, "en"), (6, "", None), (7, " \t ", "en"), (8, "12345 !!", "en"), (9, "zzqx " * 40, "en"), (200, EN * 800, "en"),
              (300, EN + ITEM, "en"), (300, EN + "clean text of the same id", "en"), (301, "write to a.b@c.de or +1 (527) 555-9774 " + EN, "en")]
    folder = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame([(i, t, l, "s", None if t is None else len(t), "r", k, [1]) for k, (i, t, l) in enumerate(texts)],
                               "doc_id long, text string, lang string, source string, n_chars long, row string, kind int, `__row` array<int>")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return df.repartition(3).persist(), str(folder)


def counted(df):
    return Counter(tuple(str(v) for v in r) for r in df.collect())


def test_language_stage_row_by_row(spark, rows):
    docs, folder = rows
    model = langid_kn.fit(docs)
    classify = langid_kn._classifier(type("Shared", (), {"value": model}))
    want = Counter()
    for r in docs.collect():
        if not classify([r.text])[2][0]:
            want[tuple(str(v) for v in r)] += 1
    out = corpus_pipeline.known_language(spark, docs, folder)
    assert out.columns == docs.columns and counted(out) == want
    texts = {r.text for r in out.collect()}
    assert not texts & {None, "", " \t ", "12345 !!"} and EN + "3 more" in texts and DE in texts


def shingles(text):
    words = (text or "").split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_near_duplicate_stage_against_brute_force(spark, rows):
    docs, folder = rows
    all_rows = docs.collect()
    sets = [frozenset(shingles(r.text.lower() if r.text else "")) for r in all_rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(all_rows):
        if sets[k]:
            groups.setdefault(find(k), []).append((r.doc_id is None, r.doc_id or 0))
    out = corpus_pipeline.near_duplicates(spark, docs, folder)
    got = out.collect()
    assert out.columns == docs.columns
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got if shingles(r.text)) == Counter(min(g) for g in groups.values())
    assert sum(not shingles(r.text) for r in got) == sum(not s for s in sets)


def test_contamination_stage(spark, rows):
    docs, folder = rows
    out = corpus_pipeline.decontaminate(spark, docs, folder)
    assert counted(out) == counted(docs.where(F.col("text").isNull() | ~F.col("text").contains(ITEM)))


def test_personal_data_stage(spark, rows):
    docs, folder = rows
    out = corpus_pipeline.redact_personal_data(spark, docs, folder)
    assert out.columns == docs.columns
    want = docs.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"a\.b@c\.de", "[EMAIL]"), r"\+1 \(527\) 555-9774", "[PHONE]")) \
        .withColumn("n_chars", F.length("text").cast("long"))
    assert counted(out) == counted(want)


def test_packing_stage(spark, rows):
    docs, folder = rows
    out = corpus_pipeline.pack(spark, docs, folder).collect()
    ids = packing.DocumentIds()
    want = Counter((r.doc_id, len(x)) for r in docs.collect() for x in ids.of([r.text]))
    assert Counter((r.doc_id, r.doc_tokens) for r in out if r.start == 0) == want
    assert sum(r.length for r in out) == sum(n * c for (_, n), c in want.items())
    used = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(spark, rows):
    docs, folder = rows
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).isEmpty(), name
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert counted(spaced_seeds.keep_clean(docs, nothing)) == counted(docs)
    assert langid_kn.keep_known(docs, langid_kn.fit(docs.where("lang = 'none'"))).isEmpty()
    assert pii_gbt.redact(docs.limit(0)).columns == docs.columns
