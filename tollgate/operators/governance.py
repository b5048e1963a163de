"""Release metadata checks, and the ``releases`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import METADATA_FIELDS, Release
from ..functions.literals import literal_frame
from ..functions.text import js_trim, placeholder_like
from .findings import evidence_rows, finding_rows

RELEASE_SCHEMA = "release_id string, " + ", ".join(f"{f} string" for f in METADATA_FIELDS)


def releases_frame(spark: SparkSession, releases: list[Release]) -> DataFrame:
    rows = [tuple([r.release_id] + [getattr(r, f) for f in METADATA_FIELDS]) for r in releases]
    return literal_frame(spark, rows, RELEASE_SCHEMA)


def clean_releases(releases: DataFrame) -> DataFrame:
    """Missing fields become '' and every field is trimmed."""
    cols = [F.col("release_id").cast("string").alias("release_id")]
    for f in METADATA_FIELDS:
        src = F.col(f) if f in releases.columns else F.lit(None)
        cols.append(js_trim(F.coalesce(src.cast("string"), F.lit(""))).alias(f))
    return releases.select(*cols)


def governance_findings(releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing provenance and missing license, one finding each per release."""
    r = clean_releases(releases)
    prov = r.where(placeholder_like(F.col("provenance")))
    lic = r.where(placeholder_like(F.col("license")))
    findings = finding_rows(
        prov, "missing-provenance", F.lit(1),
        F.lit("The release metadata does not say where the data came from.")).unionByName(
        finding_rows(lic, "missing-license", F.lit(1),
                     F.lit("The release metadata states no license or permission basis.")))
    evidence = evidence_rows(
        prov, "missing-provenance", F.lit("metadata:provenance"),
        detail=F.lit("No usable provenance statement was supplied."),
        ordinal=F.lit(1)).unionByName(evidence_rows(
            lic, "missing-license", F.lit("metadata:license"),
            detail=F.lit("No usable license or usage basis was supplied."),
            ordinal=F.lit(1)))
    return findings, evidence
