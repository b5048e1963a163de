"""PII cells, findings by kind, and the PII cell count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import evidence_rows, finding_rows, plural, top_k
from .prepare import Prepared


def pii_cells(prep: Prepared) -> DataFrame:
    """One row per (cell, kind) with at least one validated match."""
    return (prep.df.select("release_id", "_row", F.explode("pii_hits").alias("h"))
            .select("release_id", (F.col("_row") + 1).alias("row"),
                    F.col("h.col_pos").alias("col_pos"), F.col("h.column").alias("column"),
                    F.col("h.kind").alias("kind"), F.col("h.matches").cast("bigint").alias("matches")))


def pii_by_kind(prep: Prepared) -> DataFrame:
    """Cells and matches per kind (the finding count is cells)."""
    return (pii_cells(prep).groupBy("release_id", "kind")
            .agg(F.count(F.lit(1)).alias("cells"), F.sum("matches").cast("bigint").alias("matches")))


def pii_cell_count(prep: Prepared) -> DataFrame:
    """Distinct (row, column) cells with any kind, per release; no shuffle
    beyond the final per-release sum."""
    per_row = F.size(F.array_distinct(F.transform("pii_hits", lambda h: h["col_pos"])))
    return prep.df.groupBy("release_id").agg(F.sum(per_row).cast("bigint").alias("pii_cells"))


def pii_findings(prep: Prepared) -> tuple[DataFrame, DataFrame]:
    by_kind = pii_by_kind(prep)
    title = F.create_map(*[x for p in prep.patterns for x in (F.lit(p.kind), F.lit(p.titles()[0]))])
    specs = {f"pii-{p.kind}": ("pii", "block", f"Potential {p.titles()[1]}") for p in prep.patterns}
    summary = F.concat(F.lit("Found by the pattern for "), title[F.col("kind")], F.lit(": "),
                       F.col("cells").cast("string"), plural(F.col("cells"), " cell.", " cells."))
    findings = finding_rows(by_kind, F.concat(F.lit("pii-"), F.col("kind")), F.col("cells"),
                            summary, specs)
    k = prep.limits.evidence_per_finding
    cells = top_k(pii_cells(prep), ["release_id", "kind"], [F.col("row"), F.col("col_pos")], k)
    evidence = evidence_rows(
        cells, F.concat(F.lit("pii-"), F.col("kind")),
        F.concat_ws(":", F.lit("pii"), F.col("kind"), F.col("row").cast("string"), F.col("column")),
        row=F.col("row"), column=F.col("column"),
        masked=F.concat(F.lit("["), F.col("kind"), F.lit(" redacted]")),
        detail=F.concat(F.col("matches").cast("string"),
                        plural(F.col("matches"), " hit", " hits"),
                        F.lit("; the cell stays hidden.")),
        ordinal=F.col("__rank"))
    return findings, evidence
