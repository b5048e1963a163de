"""Exact duplicates (equal fingerprint without the id column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import pairs_of
from .findings import bounded_broadcast, evidence_rows, finding_rows, plural, top_k
from .prepare import Prepared


def exact_groups(prep: Prepared) -> DataFrame:
    """Fingerprint groups with more than one row (hash aggregate with a
    map-side partial, so a hot group is combined before the shuffle)."""
    return (prep.df.groupBy("release_id", "fp_exact")
            .agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first_row"))
            .where(F.col("n") > 1))


def exact_pairs(prep: Prepared) -> DataFrame:
    """Groups and pairs, sum of n(n-1)/2, per release (releases without
    duplicates have no row)."""
    return (exact_groups(prep).groupBy("release_id")
            .agg(F.count(F.lit(1)).alias("groups"),
                 F.sum(pairs_of(F.col("n"))).cast("bigint").alias("pairs")))


def exact_evidence(prep: Prepared) -> DataFrame:
    """The first pairs in (group first appearance, left, right) order.

    Only the first k groups can contribute, and inside a group the first k
    pairs use at most its first k+1 rows: both are top-k selections, so the
    work stays bounded whatever the size of the largest group.
    """
    k = prep.limits.evidence_per_finding
    groups = top_k(exact_groups(prep), ["release_id"], [F.col("first_row")], k, "__g")
    groups = bounded_broadcast(groups.select("release_id", "fp_exact", "first_row", "__g"),
                               k * prep.n_releases)
    members = top_k(prep.df.select("release_id", "fp_exact", "_row")
                    .join(groups, ["release_id", "fp_exact"]),
                    ["release_id", "fp_exact"], [F.col("_row")], k + 1, "__m")
    a, b = members.alias("a"), members.alias("b")
    pairs = (a.join(b, (F.col("a.release_id") == F.col("b.release_id"))
                    & (F.col("a.fp_exact") == F.col("b.fp_exact"))
                    & (F.col("a._row") < F.col("b._row")))
             .select(F.col("a.release_id").alias("release_id"), F.col("a.__g").alias("__g"),
                     (F.col("a._row") + 1).alias("l"), (F.col("b._row") + 1).alias("r")))
    top = top_k(pairs, ["release_id"], [F.col("__g"), F.col("l"), F.col("r")], k)
    return evidence_rows(
        top, "exact-duplicates",
        F.concat_ws(":", F.lit("exact"), F.col("l").cast("string"), F.col("r").cast("string")),
        row=F.col("l"), other_row=F.col("r"),
        detail=F.lit("Both rows have one fingerprint; the id is not part of it."),
        ordinal=F.col("__rank"))


def exact_findings(prep: Prepared) -> tuple[DataFrame, DataFrame]:
    pairs = exact_pairs(prep)
    summary = F.concat(F.lit("Rows that repeat another one: "), F.col("pairs").cast("string"),
                       plural(F.col("pairs"), " pair.", " pairs."))
    return (finding_rows(pairs.where(F.col("pairs") > 0), "exact-duplicates", F.col("pairs"),
                         summary), exact_evidence(prep))
