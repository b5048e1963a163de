"""Plan shape: no query plans a Cartesian product or a nested-loop join
(the near-duplicate join is an equi-join), and scans read only the
columns they need."""

from __future__ import annotations

import os

import pytest

from tollgate.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    bad = {}
    for name, fn in catalog.QUERIES.items():
        df = fn(spark, SF)
        df.collect()  # materialise so adaptive plans are final
        plan = _plan(df)
        hits = [b for b in BANNED if b in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_documents_scan_is_pruned(spark):
    from tollgate.plans import views

    df = views.documents_view(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "quality" in plan and "toxic" not in plan


def test_similarity_join_is_an_equi_join_of_thin_rows(spark):
    """The join itself, before anything of it is kept."""
    import re

    from tollgate.operators import neardup
    from tollgate.plans import views

    prep = views.documents_prepared(spark, SF)
    neardup.token_sets(prep)
    plan = _plan(neardup.similar_sets(prep))
    assert "Generate posexplode" in plan and "Join" in plan
    assert not [b for b in BANNED if b in plan]
    assert re.search(r"Join \[release_id#\w+, tok#\w+\], \[release_id#\w+, tok#\w+\]", plan)
