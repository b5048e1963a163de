"""Uniform findings / evidence frames and the bounded top-k helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# FIXED VALUES: finding identity (id, type, category, severity, title) in
# emission order.
FINDING_SPECS = {
    "pii-email": ("pii", "block", "Potential email addresses"),
    "pii-phone": ("pii", "block", "Potential Malaysian phone numbers"),
    "pii-nric": ("pii", "block", "Potential Malaysian NRIC-like values"),
    "pii-ip": ("pii", "block", "Potential IPv4 addresses"),
    "exact-duplicates": ("exact-duplicate", "warn", "Exact duplicate records"),
    "near-duplicates": ("near-duplicate", "warn", "Near-duplicate records"),
    "split-leakage": ("split-leakage", "block", "Train/test split leakage"),
    "conflicting-labels": ("conflicting-label", "block", "Conflicting labels"),
    "class-imbalance": ("class-imbalance", "warn", "Class imbalance"),
    "missing-provenance": ("missing-provenance", "block", "Missing provenance"),
    "missing-license": ("missing-license", "block", "Missing license or usage basis"),
}
FINDING_ORDER = {fid: i + 1 for i, fid in enumerate(FINDING_SPECS)}

REMEDIATION = {
    "pii-email": "Take the identifiers out of the source table itself; what this report masks is "
                 "still in the data.",
    "exact-duplicates": "Keep one row of each group unless the repetition carries meaning.",
    "near-duplicates": "Read the listed pairs and decide which variants earn their place.",
    "split-leakage": "Assign splits by group of equal rows, then build the splits anew.",
    "conflicting-labels": "Have the disagreeing rows labelled again by someone who sees them together.",
    "class-imbalance": "Report results for each class on its own before trusting an average.",
    "missing-provenance": "Write down where the rows come from and who answers for them.",
    "missing-license": "Find the terms under which the rows may be shared and name them.",
}
for _k in ("pii-phone", "pii-nric", "pii-ip"):
    REMEDIATION[_k] = REMEDIATION["pii-email"]

FINDING_COLUMNS = ["release_id", "finding_id", "type", "category", "severity", "title",
                   "summary", "count", "remediation", "ordinal"]
EVIDENCE_COLUMNS = ["release_id", "finding_id", "key", "row", "other_row", "column",
                    "masked_value", "detail", "ordinal"]


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def finding_rows(df: DataFrame, finding_id: str | Column, count: Column,
                 summary: Column, more: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """Findings from a frame with ``release_id`` (one row per raised finding); ``more``
    specifies ids beyond the known ones, which come after these."""
    if isinstance(finding_id, str):
        ftype, severity, title = FINDING_SPECS[finding_id]
        return df.select(
            "release_id", F.lit(finding_id).alias("finding_id"), F.lit(ftype).alias("type"),
            F.lit(finding_id if ftype == "pii" else ftype).alias("category"),
            F.lit(severity).alias("severity"), F.lit(title).alias("title"),
            summary.alias("summary"), count.cast("bigint").alias("count"),
            F.lit(REMEDIATION[finding_id]).alias("remediation"),
            F.lit(FINDING_ORDER[finding_id]).alias("ordinal"))
    specs = FINDING_SPECS | {k: v for k, v in (more or {}).items() if k not in FINDING_SPECS}
    spec = F.create_map(*[x for o, (fid, (t, s, ti)) in enumerate(specs.items(), 1)
                          for x in (F.lit(fid), F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"),
                                                         F.lit(ti).alias("ti"),
                                                         F.lit(REMEDIATION.get(fid, REMEDIATION["pii-email"])).alias("r"),
                                                         F.lit(o).alias("o")))])
    sp = spec[finding_id]
    return df.select(
        "release_id", finding_id.alias("finding_id"), sp["t"].alias("type"),
        F.when(sp["t"] == "pii", finding_id).otherwise(sp["t"]).alias("category"),
        sp["s"].alias("severity"), sp["ti"].alias("title"), summary.alias("summary"),
        count.cast("bigint").alias("count"), sp["r"].alias("remediation"),
        sp["o"].alias("ordinal"))


def evidence_rows(df: DataFrame, finding_id: str | Column, key: Column, *,
                  row: Column | None = None, other_row: Column | None = None,
                  column: Column | None = None, masked: Column | None = None,
                  detail: Column, ordinal: Column) -> DataFrame:
    fid = F.lit(finding_id) if isinstance(finding_id, str) else finding_id
    return df.select(
        "release_id", fid.alias("finding_id"), key.alias("key"),
        (row if row is not None else F.lit(None)).cast("bigint").alias("row"),
        (other_row if other_row is not None else F.lit(None)).cast("bigint").alias("other_row"),
        (column if column is not None else F.lit(None)).cast("string").alias("column"),
        (masked if masked is not None else F.lit(None)).cast("string").alias("masked_value"),
        detail.alias("detail"), ordinal.cast("int").alias("ordinal"))


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int,
          name: str = "__rank") -> DataFrame:
    """The first ``k`` rows of every partition.  ``row_number() <= k`` plans
    as a WindowGroupLimit, so each map task keeps at most ``k`` rows per
    partition key before the shuffle: a key holding a third of the table
    never reaches one task whole."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def bounded_broadcast(df: DataFrame, bound_rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast a frame whose row count is proven to be at most
    ``bound_rows``; beyond ``limit`` leave the join to the planner."""
    return F.broadcast(df) if bound_rows <= limit else df
