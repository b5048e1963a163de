"""Split leakage -- identical examples (id and split set aside,
label kept) that sit in more than one split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import empty_frame
from ..functions.tokens import exact
from .findings import bounded_broadcast, evidence_rows, finding_rows, plural, top_k
from .prepare import Prepared


def _split_counts(prep: Prepared) -> DataFrame:
    return (prep.df.where(F.col("split_norm").isNotNull())
            .groupBy("release_id", "fp_split", "split_norm")
            .agg(F.count(F.lit(1)).alias("n_s"), F.min("_row").alias("first_s")))


def leakage_groups(prep: Prepared) -> DataFrame:
    """Per fingerprint: rows with a split, splits, and cross-split pairs
    (n^2 - sum n_s^2) / 2 -- a two-level aggregate, no pair enumeration."""
    if not prep.has_role("split"):
        return empty_frame(prep.df.sparkSession, "release_id string, fp_split binary, "
                           "n bigint, splits bigint, pairs bigint")
    return (_split_counts(prep).groupBy("release_id", "fp_split")
            .agg(F.sum("n_s").alias("n"), F.count(F.lit(1)).alias("splits"),
                 ((exact(F.sum("n_s")) * exact(F.sum("n_s"))
                   - F.sum(exact(F.col("n_s")) * exact(F.col("n_s")))) / 2)
                 .cast("bigint").alias("pairs"))
            .where(F.col("pairs") > 0))


def leakage_pairs(prep: Prepared) -> DataFrame:
    return (leakage_groups(prep).groupBy("release_id")
            .agg(F.count(F.lit(1)).alias("groups"), F.sum("pairs").cast("bigint").alias("pairs")))


def leakage_evidence(prep: Prepared) -> DataFrame:
    """Each row paired with the first row of every other split seen before
    it, in (group first appearance over all rows, row, first) order.

    A row qualifies exactly when its row is at or after the first row of
    the group's second split, so: take the first k leaking groups, their
    first k qualifying rows and first k+1 splits -- all top-k selections.
    """
    k = prep.limits.evidence_per_finding
    if not prep.has_role("split"):
        return evidence_rows(prep.df.limit(0), "split-leakage", F.lit(""), detail=F.lit(""),
                             ordinal=F.lit(0))
    counts = _split_counts(prep)
    group_first = prep.df.groupBy("release_id", "fp_split").agg(F.min("_row").alias("g_first"))
    leaking = leakage_groups(prep).select("release_id", "fp_split")
    ranked = top_k(leaking.join(group_first, ["release_id", "fp_split"]),
                   ["release_id"], [F.col("g_first")], k, "__g")
    ranked = bounded_broadcast(ranked, k * prep.n_releases)
    splits = top_k(counts.join(ranked, ["release_id", "fp_split"]),
                   ["release_id", "fp_split"], [F.col("first_s")], k + 1, "__s")
    second = (splits.where(F.col("__s") == 2)
              .select("release_id", "fp_split", F.col("first_s").alias("second_first")))
    rows = (prep.df.where(F.col("split_norm").isNotNull())
            .select("release_id", "fp_split", "_row", "split_norm")
            .join(bounded_broadcast(second, k * prep.n_releases), ["release_id", "fp_split"])
            .where(F.col("_row") >= F.col("second_first")))
    rows = top_k(rows, ["release_id", "fp_split"], [F.col("_row")], k, "__r")
    s = splits.select("release_id", "fp_split", "__g", F.col("split_norm").alias("o_split"),
                      "first_s")
    cand = (rows.join(s, ["release_id", "fp_split"])
            .where((F.col("o_split") != F.col("split_norm")) & (F.col("first_s") < F.col("_row"))))
    top = prep.with_role(top_k(cand, ["release_id"], [F.col("__g"), F.col("_row"), F.col("first_s")], k), "split")
    return evidence_rows(
        top, "split-leakage",
        F.concat_ws(":", F.lit("leakage"), (F.col("first_s") + 1).cast("string"),
                    (F.col("_row") + 1).cast("string")),
        row=F.col("first_s") + 1, other_row=F.col("_row") + 1,
        column=F.col("__role"),
        detail=F.lit("Two splits hold this row; which ones is not shown."),
        ordinal=F.col("__rank"))


def leakage_findings(prep: Prepared) -> tuple[DataFrame, DataFrame]:
    pairs = leakage_pairs(prep)
    summary = F.concat(F.lit("Equal rows in different splits: "), F.col("pairs").cast("string"),
                       plural(F.col("pairs"), " pair.", " pairs."))
    return (finding_rows(pairs, "split-leakage", F.col("pairs"), summary),
            leakage_evidence(prep))
