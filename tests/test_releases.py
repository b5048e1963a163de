"""Many releases in one job equal one audit per release."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tollgate import audit
from tollgate.plans import views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

COUNTS = ["row_count", "pii_cell_count", "exact_duplicate_pairs", "near_duplicate_pairs",
          "leakage_pairs", "conflicting_groups", "near_comparisons",
          "label_classes", "status", "block_count", "warning_count"]


def test_regrouped_sources_equal_separate_audits(spark):
    multi = {r.release_id: r for r in views.sources_audit(spark, SF).summary.collect()}
    releases = views.source_releases(spark, SF)
    for source in ("src0", "src3", "src19"):
        df = views.documents_view(spark, SF, with_source=True).where(F.col("source") == source)
        rel = releases.where(F.col("release_id") == source)
        single = audit(df, rel, release_col="source", roles=views.DOCS_ROLES,
                       order_by=[F.col("doc_id")]).summary.first()
        assert single.release_id == source
        assert [single[c] for c in COUNTS] == [multi[source][c] for c in COUNTS], source
