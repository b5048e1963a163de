"""The query catalog: one DataFrame per operator, over the driver's tables.

Every query reads the given tables (through the audited views of
``views``) and returns columns named exactly like its oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import duplicates, gate, governance, hashing, labels, leakage, neardup, pii, scoring
from ..sources import validate
from . import views

Query = Callable[[SparkSession, str], DataFrame]

def _ev():
    return ["release_id", "key", "row", "other_row", F.col("ordinal").cast("bigint").alias("ordinal")]


def _prep(spark, sf, limits=None):
    return views.documents_prepared(spark, sf, limits or views.Limits())


def _rows(spark, sf):
    return views.rows_prepared(spark, sf)


def _texts(spark, sf):
    return views.texts_prepared(spark, sf)


# --- sources / intake --------------------------------------------------------

def q_cell_limit_violations(spark, sf):
    """Cells over the 4,096-character limit (UTF-16 units), per table and
    string column, for the text-bearing tables."""
    out = None
    for name in ("documents", "pages", "conversations", "benchmark"):
        t = views.table(spark, sf, name)
        v = validate.cell_limit_violations(t, table_name=name)
        out = v if out is None else out.unionByName(v)
    return out


def q_scalar_violations(spark, sf):
    """Non-scalar columns and non-finite numbers, per table and column."""
    out = None
    for name in ("embeddings", "events", "lineitem"):
        v = validate.scalar_violations(views.table(spark, sf, name), table_name=name)
        out = v if out is None else out.unionByName(v)
    return out


# --- PII ------------------------------------------------------------------------

def q_pii_cells(spark, sf):
    return pii.pii_cells(_prep(spark, sf)).select("release_id", "row", "column", "kind", "matches")


def q_pii_by_kind(spark, sf):
    return pii.pii_by_kind(_prep(spark, sf))


def q_pii_cell_count(spark, sf):
    return pii.pii_cell_count(_prep(spark, sf))


def q_pii_pages(spark, sf):
    """PII cells of the raw web pages (url and html), per kind."""
    from ..operators.prepare import prepare
    from ..config import Roles
    p = prepare(views.table(spark, sf, "pages"), release_id="pages", roles=Roles(id="page_id"),
                order_by=[F.col("page_id")])
    return pii.pii_by_kind(p)


def q_pii_identifiers(spark, sf):
    """Identifiers held as numbers and as text, per column and kind."""
    from ..operators.prepare import prepare
    from ..config import Roles
    p = prepare(views.order_identifiers(spark, sf), release_id="orders", roles=Roles(id="id"), order_by=[F.col("id")])
    return pii.pii_cells(p).groupBy("column", "kind").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("matches").cast("bigint").alias("matches"))


def q_row_shape_violations(spark, sf):
    """Event records whose keys are not those of the first; purchases carry one more."""
    e = views.table(spark, sf, "events")
    props = F.from_json("props", "map<string,string>")
    cells = F.when(F.col("event_type") == "purchase", F.map_concat(props, F.create_map(F.lit("Amount "), F.col("value").cast("string")))) \
        .otherwise(props)
    return validate.row_shape_violations(e.select((F.col("event_id") + 1).alias("row"), cells.alias("cells")))


def q_table_hash(spark, sf):
    """One hash over all rows of ``labels`` in the order of their ids."""
    return hashing.table_hash(views.table(spark, sf, "labels"), ["doc_id"])


# --- exact duplicates -----------------------------------------------------------------

def q_exact_duplicate_groups(spark, sf):
    return duplicates.exact_groups(_rows(spark, sf)).select(
        "release_id", (F.col("first_row") + 1).alias("first_row"), "n")


def q_exact_duplicate_pairs(spark, sf):
    return duplicates.exact_pairs(_rows(spark, sf))


def q_exact_duplicate_evidence(spark, sf):
    return duplicates.exact_evidence(_rows(spark, sf)).select(*_ev())


# --- near duplicates ------------------------------------------------------------------

def q_token_stats(spark, sf):
    return neardup.token_stats(_prep(spark, sf))


def q_near_duplicate_pairs(spark, sf):
    return neardup.near_pairs(_prep(spark, sf))


def q_near_duplicate_evidence(spark, sf):
    return neardup.near_evidence(_prep(spark, sf)).select(*_ev(), "detail")


# --- leakage / labels -----------------------------------------------------------------

def q_split_leakage_groups(spark, sf):
    p = _texts(spark, sf)
    first = p.df.groupBy("release_id", "fp_split").agg(F.min("_row").alias("g_first"))
    return (leakage.leakage_groups(p).join(first, ["release_id", "fp_split"])
            .select("release_id", (F.col("g_first") + 1).alias("first_row"), "n", "splits",
                    "pairs"))


def q_split_leakage_pairs(spark, sf):
    return leakage.leakage_pairs(_texts(spark, sf))


def q_split_leakage_evidence(spark, sf):
    return leakage.leakage_evidence(_texts(spark, sf)).select(*_ev())


def q_conflicting_labels(spark, sf):
    return labels.conflicting_labels(_texts(spark, sf))


def q_conflict_evidence(spark, sf):
    return labels.conflict_evidence(_texts(spark, sf)).select(*_ev(), "detail")


def q_label_distribution(spark, sf):
    return labels.label_distribution(_rows(spark, sf)).select("release_id", "category", "count")


def q_class_imbalance(spark, sf):
    from ..functions.tokens import percent_text
    return labels.class_imbalance(_rows(spark, sf)).select(
        "release_id", "rows", "classes", "largest", "smallest",
        percent_text(F.col("majority_share")).alias("majority_pct"),
        percent_text(F.col("minority_share")).alias("minority_pct"), "imbalanced")


# --- governance / gate / summary over per-source releases -----------------------------

def q_governance_findings(spark, sf):
    f, _ = governance.governance_findings(views.source_releases(spark, sf))
    return f.select("release_id", "finding_id", "severity", "count")


def q_audit_findings(spark, sf):
    return views.sources_audit(spark, sf).findings.select(
        "release_id", "finding_id", "severity", "count")


def q_gate_status(spark, sf):
    return views.sources_audit(spark, sf).gate()


def q_audit_summary(spark, sf):
    return views.sources_audit(spark, sf).summary


def q_evidence_capped(spark, sf):
    ev = views.documents_audit(spark, sf).evidence
    return gate.cap_evidence(ev, 6).select(
        "release_id", "finding_id", "key", "row", "other_row", "column", "masked_value",
        F.col("ordinal").cast("bigint").alias("ordinal"))


# --- hashes and card -----------------------------------------------------------------

def q_dataset_fingerprint(spark, sf):
    return hashing.dataset_fingerprint(_prep(spark, sf).df)


def q_configuration_hash(spark, sf):
    return hashing.configuration_hash(views.source_releases(spark, sf))


def q_report_hash(spark, sf):
    return views.sources_audit(spark, sf).hashes().select("release_id", "report_hash")


def q_data_card(spark, sf):
    return views.sources_audit(spark, sf).card()


# --- scoring: the audit of each source against the audit of the whole table -----------

def _keys(audit):
    return scoring.prediction_keys(audit.findings, audit.evidence, audit.row_ids())


def _source_keys(spark, sf):
    """Keys of the audit of each source, as keys of the whole table."""
    k = _keys(views.sources_audit(spark, sf))
    return k.select(F.lit("documents").alias("case_id"), "category", F.concat(
        F.lit("documents"), F.substring(F.col("key"), F.length("case_id") + 1, F.length("key"))).alias("key")).distinct()


def q_prediction_keys(spark, sf):
    return _keys(views.documents_audit(spark, sf))


def _levels(spark, sf):
    """All scores from one join of the keys, written once: a row for each case and category."""
    return views.documents_audit(spark, sf).prepared.memo("scores", lambda: scoring.score_levels(
        _source_keys(spark, sf), _keys(views.documents_audit(spark, sf))))


def q_score_by_category(spark, sf):
    return scoring.category_scores(_levels(spark, sf))


def q_score_by_case(spark, sf):
    return scoring.case_scores(_levels(spark, sf))


def q_score_overall(spark, sf):
    return scoring.overall_scores(_levels(spark, sf))


def q_metadata_violations(spark, sf):
    """Over-long metadata of the releases derived from each source (limit 24)."""
    return validate.metadata_violations(views.source_releases(spark, sf), views.Limits(metadata_characters=24))


def q_clean_rows_flagged(spark, sf):
    a = views.documents_audit(spark, sf)
    return scoring.clean_rows_flagged(a.evidence, a.row_ids())


QUERIES: dict[str, Query] = {
    "cell_limit_violations": q_cell_limit_violations,
    "scalar_violations": q_scalar_violations,
    "pii_cells": q_pii_cells,
    "pii_by_kind": q_pii_by_kind,
    "pii_cell_count": q_pii_cell_count,
    "pii_pages": q_pii_pages,
    "pii_identifiers": q_pii_identifiers,
    "row_shape_violations": q_row_shape_violations,
    "table_hash": q_table_hash,
    "exact_duplicate_groups": q_exact_duplicate_groups,
    "exact_duplicate_pairs": q_exact_duplicate_pairs,
    "exact_duplicate_evidence": q_exact_duplicate_evidence,
    "token_stats": q_token_stats,
    "near_duplicate_pairs": q_near_duplicate_pairs,
    "near_duplicate_evidence": q_near_duplicate_evidence,
    "split_leakage_groups": q_split_leakage_groups,
    "split_leakage_pairs": q_split_leakage_pairs,
    "split_leakage_evidence": q_split_leakage_evidence,
    "conflicting_labels": q_conflicting_labels,
    "conflict_evidence": q_conflict_evidence,
    "label_distribution": q_label_distribution,
    "class_imbalance": q_class_imbalance,
    "governance_findings": q_governance_findings,
    "audit_findings": q_audit_findings,
    "gate_status": q_gate_status,
    "audit_summary": q_audit_summary,
    "evidence_capped": q_evidence_capped,
    "dataset_fingerprint": q_dataset_fingerprint,
    "configuration_hash": q_configuration_hash,
    "report_hash": q_report_hash,
    "data_card": q_data_card,
    "prediction_keys": q_prediction_keys,
    "score_by_category": q_score_by_category,
    "score_by_case": q_score_by_case,
    "score_overall": q_score_overall,
    "metadata_violations": q_metadata_violations,
    "clean_rows_flagged": q_clean_rows_flagged,
}
