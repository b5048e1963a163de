"""``audit``: prepare once, run every detector as an aggregate of the
prepared table, roll findings up to a gate per release."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Limits, Release, Roles
from ..functions.pii import PATTERNS, PiiPattern
from ..operators import duplicates, gate, governance, hashing, labels, leakage, neardup, pii
from ..operators.card import data_card
from ..operators.findings import EVIDENCE_COLUMNS, FINDING_COLUMNS
from ..operators.prepare import Prepared, prepare
from ..sources.validate import check_metadata


@dataclass
class AuditResult:
    prepared: Prepared
    releases: DataFrame
    findings: DataFrame
    evidence: DataFrame
    summary: DataFrame
    label_distribution: DataFrame

    def gate(self) -> DataFrame:
        return self.summary.select("release_id", "status", "block_count", "warning_count")

    def hashes(self) -> DataFrame:
        ds = hashing.dataset_fingerprint(self.prepared.df)
        cfg = hashing.configuration_hash(self.releases)
        base = self.releases.select("release_id").join(ds, "release_id", "left").join(
            cfg, "release_id", "left")
        rep = hashing.report_hash(self.releases, self.summary, self.findings, self.evidence, base)
        return base.join(rep, "release_id", "left")

    def card(self) -> DataFrame:
        return data_card(self.releases, self.summary, self.findings, self.hashes())

    def row_ids(self) -> DataFrame:
        return self.prepared.df.select("release_id", (F.col("_row") + 1).alias("row"), "id_text")


def _union(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select(*columns) for f in frames])


def audit(df: DataFrame, release: Release | DataFrame | None = None, *,
          release_col: str | None = None, roles: Roles | None = None,
          limits: Limits = Limits(), order_by: list[Column] | None = None,
          prepared: Prepared | None = None, patterns: Sequence[PiiPattern] = PATTERNS) -> AuditResult:
    """Audit a table (or many releases of one table, keyed by ``release_col``).

    ``release`` is one :class:`Release` (single-release audit) or a
    ``releases`` DataFrame with a ``release_id`` column, each with label, split
    and id columns of its own.  ``patterns`` are the kinds of identifiers looked for.  The prepared table and each detector's result
    are written as they are built, so this call runs jobs; the frames it
    returns are lazy over what is written.
    """
    spark = df.sparkSession
    if isinstance(release, DataFrame):
        releases = governance.clean_releases(release)
        rel_obj = None
    else:
        rel_obj = release or Release()
        releases = governance.releases_frame(spark, [rel_obj])
    check_metadata(releases, limits)
    rid = rel_obj.release_id if rel_obj is not None else "release"
    prep = prepared or prepare(df, release_id=rid, release_col=release_col, roles=roles,
                               release=rel_obj, limits=limits, order_by=order_by,
                               releases=releases if rel_obj is None else None, patterns=patterns)

    # detector results are kept on the prepared table, keyed by the limits
    # they depend on
    k = prep.limits.evidence_per_finding
    # per release: at most a PII finding for each pattern, 2 label and 3 other findings, k
    # evidence each; all findings are one job, all evidence another
    bound = prep.n_releases * (len(prep.patterns) + 5)
    detectors = (pii.pii_findings, duplicates.exact_findings, neardup.near_findings, leakage.leakage_findings, labels.label_findings)
    raised = prep.memo(f"findings:{k}", lambda: _union([d(prep)[0] for d in detectors], FINDING_COLUMNS), bound)
    shown = prep.memo(f"evidence:{k}", lambda: _union([d(prep)[1] for d in detectors], EVIDENCE_COLUMNS), bound * max(k, 1))
    missing = governance.governance_findings(releases)
    findings = _union([raised, missing[0]], FINDING_COLUMNS)
    evidence = _union([shown, missing[1]], EVIDENCE_COLUMNS)

    summary = audit_summary(prep, releases, findings)
    return AuditResult(prepared=prep, releases=releases, findings=findings, evidence=evidence,
                       summary=summary, label_distribution=labels.label_distribution(prep))


def audit_summary(prep: Prepared, releases: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per release; every metric is a per-release aggregate joined on
    release_id (tables of one row per release)."""
    status = gate.gate_status(releases, findings)
    stats = neardup.token_stats(prep)

    def raised(finding_id: str):
        return F.max(F.when(F.col("finding_id") == finding_id, F.col("count")))

    # what the findings have counted already is read from them
    counted = findings.groupBy("release_id").agg(
        raised("exact-duplicates").alias("exact_duplicate_pairs"),
        raised("near-duplicates").alias("near_duplicate_pairs"),
        raised("split-leakage").alias("leakage_pairs"),
        raised("conflicting-labels").alias("conflicting_groups"))
    parts = [
        stats.select("release_id", F.col("rows").alias("row_count"),
                     F.col("total_comparisons").alias("near_comparisons")),
        pii.pii_cell_count(prep).select("release_id", F.col("pii_cells").alias("pii_cell_count")),
        counted,
        labels.label_distribution(prep).groupBy("release_id").agg(
            F.count(F.lit(1)).alias("label_classes")),
    ]
    out = status
    for p in parts:
        out = out.join(p, "release_id", "left")
    for role in ("label", "split", "id"):
        out = prep.with_role(out, role, f"{role}_column")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "release_id", "status",
        F.coalesce("row_count", zero).alias("row_count"),
        F.lit(len(prep.columns)).cast("bigint").alias("column_count"),
        "block_count", "warning_count",
        *[F.coalesce(c, zero).alias(c) for c in (
            "pii_cell_count", "exact_duplicate_pairs", "near_duplicate_pairs", "leakage_pairs",
            "conflicting_groups", "near_comparisons", "label_classes")],
        "label_column", "split_column", "id_column",
    )
