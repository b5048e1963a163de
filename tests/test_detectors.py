"""Detectors on the maintained fixtures and on tables of their own."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from conftest import frame, ordered
from fixtures import (DEMO_COLUMNS, DEMO_RELEASE, DEMO_ROWS, FERRY, FERRY_ROWS, GOLD_KEYS,
                      REGRESSION_CASES, governed)
from tollgate import Limits, Release, audit
from tollgate.operators import hashing, scoring


def run(spark, rows, release, columns=None, **more):
    df = frame(spark, rows, columns)
    return audit(df, release, order_by=ordered(df), **more)


def everything(res) -> str:
    """All text that an audit gives out."""
    frames = (res.findings, res.evidence, res.summary, res.label_distribution, res.card())
    return "\n".join(str(r) for f in frames for r in f.collect())


def test_table_without_faults_passes(spark):
    res = run(spark, FERRY_ROWS, FERRY)
    assert res.findings.isEmpty()
    assert [(r.status, r.row_count) for r in res.summary.collect()] == [("PASS", len(FERRY_ROWS))]


def test_demo_totals(spark):
    res = run(spark, DEMO_ROWS, DEMO_RELEASE, DEMO_COLUMNS)
    s = res.summary.first()
    assert (s.status, s.block_count, s.warning_count) == ("BLOCK", 8, 3)
    assert (s.pii_cell_count, s.exact_duplicate_pairs, s.near_duplicate_pairs,
            s.leakage_pairs, s.conflicting_groups) == (4, 1, 1, 1, 1)
    # the NRIC-like value also holds a phone match
    assert {r.finding_id: r["count"] for r in res.findings.collect()}["pii-phone"] == 2


def test_regression_suite_matches_all_expected_keys(spark):
    predicted, gold, cases = [], [], []
    for case_id, kind, rows, over in REGRESSION_CASES:
        res = run(spark, rows, governed(case_id, **over))
        keys = scoring.prediction_keys(res.findings, res.evidence, res.row_ids())
        predicted.extend((r.case_id, r.category, r.key) for r in keys.collect())
        gold.extend((case_id, k.split("|")[1], k) for k in GOLD_KEYS[case_id])
        cases.append((case_id,))
        if kind == "clean-control":
            assert scoring.clean_rows_flagged(res.evidence, res.row_ids()).isEmpty()
    schema = "case_id string, category string, key string"
    p, g = spark.createDataFrame(predicted, schema), spark.createDataFrame(gold, schema)
    overall = scoring.score_overall(p, g).first()
    assert (overall.expected, overall.matched, overall.unexpected, overall.missed) == (15, 15, 0, 0)
    assert scoring.score_by_category(p, g).count() == 11
    assert scoring.score_by_case(p, g, spark.createDataFrame(cases, "case_id string")).count() == 10
    digests = [hashing.table_hash(x, ["key"]).first().table_hash for x in (g, g.repartition(5), g.where("key <> ''").limit(3))]
    assert digests[0] == digests[1] != digests[2]


def test_no_cell_value_is_given_out(spark):
    secrets = ["zora@quokka.example", "10.20.30.40", "mulberry-lane-7"]
    rows = [{"id": f"k{i}", "feature": "the same barge", "label": f"{secrets[0]} grade {i % 2}",
             "split": f"{secrets[2]} {i}", "note": secrets[1]} for i in range(4)]
    res = run(spark, rows, FERRY)
    assert res.summary.first().leakage_pairs == 2 and res.summary.first().conflicting_groups == 1
    text = everything(res)
    assert not [s for s in secrets if s in text]


@pytest.mark.parametrize("number,kinds", [(60127654321, {"pii-phone"}), (851231145555, {"pii-nric"}),
                                          (851331145555, set()), (0.6012, set())])
def test_numbers_can_be_identifiers(spark, number, kinds):
    res = run(spark, [{"id": "a", "reading": number, "label": "x", "split": "s"}], FERRY)
    assert {r.finding_id for r in res.findings.collect()} == kinds


def test_labels_named_like_object_members_are_plain_labels(spark):
    names = ["toString"] * 9 + ["__proto__", "hasOwnProperty", "prototype"]
    res = run(spark, [{"id": f"q{i}", "feature": f"lamp {i} oil {i * 3}", "label": n, "split": "s"}
                      for i, n in enumerate(names)], FERRY)
    assert [r["count"] for r in res.label_distribution.orderBy("class_index").collect()] == [9, 1, 1, 1]
    assert not [n for n in names if n in everything(res)]


def test_declared_text_stays_text_in_the_card(spark):
    told = "[x](http://h.example) <b onclick=y> `code` ![p](q) | cell"
    card = run(spark, FERRY_ROWS, Release(release_id="u", dataset_name=told, purpose=told, provenance=told, license=told,
                                          label_column="label", split_column="split", id_column="id")).card().first()
    declared = card.markdown.split("## What was declared")[1].split("##")[0] + card.markdown.splitlines()[0]
    assert not re.search(r"[\[\]<>`|!]|://", declared.replace("- ", "")[1:].replace("#", "", 1).replace("&#", ""))
    assert "What this card does not say" in card.markdown


def test_hashes_depend_on_rows_metadata_and_nothing_else(spark):
    a, b = (run(spark, FERRY_ROWS, FERRY).hashes().first() for _ in range(2))
    assert a == b
    c = run(spark, FERRY_ROWS, Release(**{**FERRY.__dict__, "purpose": "Another"})).hashes().first()
    assert c.dataset_hash == a.dataset_hash
    assert c.configuration_hash != a.configuration_hash and c.report_hash != a.report_hash


def test_missing_configured_column_is_refused(spark):
    with pytest.raises(ValueError):
        run(spark, FERRY_ROWS, Release(release_id="x", label_column="nope"))


def _two(spark):
    rows = ([dict(r, release="one", tag="t") for r in FERRY_ROWS]
            + [{"id": f"two{i}", "feature": "equal words in all rows here", "label": str(i), "split": "a", "release": "two",
                "tag": "u" if i < 5 else "v"} for i in range(12)])
    return frame(spark, rows, ["id", "feature", "label", "split", "tag", "release"])


def _releases(spark, second):
    return spark.createDataFrame([("one", "n", "p", "l", "", "label", "split", "id"),
                                  ("two", "n", "p", "l", "", second, "split", "id")],
                                 "release_id string, dataset_name string, provenance string, license string, "
                                 "purpose string, label_column string, split_column string, id_column string")


def test_each_release_has_its_own_roles(spark):
    df = _two(spark)
    both = audit(df, _releases(spark, "tag"), release_col="release", order_by=ordered(df))
    for name, label in (("one", "label"), ("two", "tag")):
        part = df.where(F.col("release") == name).drop("release")
        alone = audit(part, Release(release_id=name, dataset_name="n", provenance="p", license="l", label_column=label,
                                    split_column="split", id_column="id"), order_by=ordered(part))
        for kind in ("findings", "evidence", "summary"):
            of = lambda res: sorted(map(str, getattr(res, kind).where(F.col("release_id") == name).collect()))
            assert of(both) == of(alone), (name, kind)


def test_release_with_an_unknown_column_is_refused_by_id(spark):
    with pytest.raises(ValueError, match="Release two"):
        audit(_two(spark), _releases(spark, "colour"), release_col="release")


def test_evidence_cap_has_a_limit():
    with pytest.raises(ValueError):
        Limits(evidence_per_finding=1001)
