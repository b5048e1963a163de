"""A caller's own identifier patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate import Release, audit
from tollgate.functions.pii import PATTERNS, PiiPattern
from tollgate.operators import pii

BADGE = PiiPattern("badge", r"\bB-[0-9]{4}\b", "B-", lambda m: F.substring(m, 3, 4).cast("int") % 7 == 0,
                   lambda digits: digits.rlike("^7777[0-9]{2}$"), ("badge number", "badge numbers"))


def test_a_fifth_kind_is_found_masked_and_rolled_up(spark):
    rows = [(1, "see B-0007 and B-0014, not B-0008", 777712), (2, "a@b.com", 12), (3, "B-0001", None), (4, None, 777799)]
    df = spark.createDataFrame(rows, "id long, text string, number long")
    meta = Release(release_id="r", provenance="own", license="own")
    res = audit(df, meta, order_by=[F.col("id")], patterns=[*PATTERNS, BADGE])
    cells = {(r.row, r.column, r.kind, r.matches) for r in pii.pii_cells(res.prepared).collect()}
    assert cells == {(1, "text", "badge", 2), (1, "number", "badge", 1), (2, "text", "email", 1), (4, "number", "badge", 1)}
    found = {r.finding_id: r for r in res.findings.collect()}
    badge = found["pii-badge"]
    assert (badge.type, badge.category, badge.severity, badge["count"]) == ("pii", "pii-badge", "block", 3)
    assert badge.title == "Potential badge numbers" and "badge number: 3 cells" in badge.summary
    assert badge.ordinal > max(r.ordinal for k, r in found.items() if k != "pii-badge")
    shown = {(r.row, r.column, r.masked_value) for r in res.evidence.where("finding_id = 'pii-badge'").collect()}
    assert shown == {(1, "text", "[badge redacted]"), (1, "number", "[badge redacted]"), (4, "number", "[badge redacted]")}
    assert res.summary.first().pii_cell_count == 4
    plain = audit(df, meta, order_by=[F.col("id")])
    assert {r.finding_id for r in plain.findings.collect()} == {"pii-email"}


def test_guards_keep_every_match_and_pass_over_plain_prose(spark):
    """A guard holds wherever the pattern matches; prose with full stops and single digits needs no scan."""
    import random
    import re

    from tollgate.functions.pii import string_match_count

    rnd = random.Random(3)
    pieces = ["1", "25", "192", "888", "0101", "14", ".", "-", " ", "a", "860101", "é"]
    rows = ["".join(rnd.choices(pieces, k=rnd.randrange(3, 14))) for _ in range(8000)]
    rows += ["10.0.0.1", "v1.2.3.4.5", "860101-14-5566", "860101145566", "1.1.1.1.", "x1.1.1.1"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    for p in PATTERNS:
        free = PiiPattern(p.kind, p.regex, "", p.valid, p.numeric, p.names)
        got = df.select(string_match_count(F.col("v"), p).alias("n"), string_match_count(F.col("v"), free).alias("want"))
        assert got.where("n <> want").count() == 0 and (p.kind not in ("ip", "nric") or got.where("n > 0").count() > 0)
    guards = {p.kind: p.guard for p in PATTERNS}
    assert not any(re.search(guards[k], "Take 2 eggs. Stir in 3.5 cups. Rest.") for k in ("ip", "nric"))


def test_a_table_without_cells_has_the_same_rows(spark):
    from conftest import frame
    from tollgate.config import Roles
    from tollgate.operators.prepare import prepare

    df = frame(spark, [{"id": str(i), "text": f"one two three four five {i // 2}", "label": str(i % 3), "split": "ab"[i % 2]}
                       for i in range(40)])
    roles = Roles(id="id", label="label", split="split")
    whole = prepare(df, release_id="r", roles=roles, order_by=[df["__seq"]])
    bare = prepare(df, release_id="r", roles=roles, order_by=[df["__seq"]], cells=False)
    assert bare.texts is None and not {"k", "pii_hits", "set_key", "place", "at_limit"} & set(bare.df.columns)
    assert sorted(bare.df.columns) == sorted(set(whole.df.columns) - {"k", "pii_hits", "set_key", "place", "at_limit"})
    assert sorted(map(tuple, bare.df.collect())) == sorted(map(tuple, whole.df.select(*bare.df.columns).collect()))
