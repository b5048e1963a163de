"""Conflicting labels, label distribution and class imbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IMBALANCE_MAJORITY, IMBALANCE_MIN_ROWS, IMBALANCE_MINORITY
from ..functions.literals import empty_frame
from ..functions.tokens import percent_text
from .findings import bounded_broadcast, evidence_rows, finding_rows, plural, top_k
from .prepare import Prepared
from .rows import with_row_number


def _label_firsts(prep: Prepared) -> DataFrame:
    # a NULL label_norm is a release without a label column
    return (prep.df.where(F.col("label_norm").isNotNull()).groupBy("release_id", "fp_feature", "label_norm")
            .agg(F.min("_row").alias("first_l")))


def conflict_groups(prep: Prepared) -> DataFrame:
    """Feature groups (id, split and label set aside) holding two or more
    normalised labels; two-level aggregate."""
    if not prep.has_role("label"):
        return empty_frame(prep.df.sparkSession, "release_id string, fp_feature binary, labels bigint, first_row bigint")
    return (_label_firsts(prep).groupBy("release_id", "fp_feature")
            .agg(F.count(F.lit(1)).alias("labels"), F.min("first_l").alias("first_row"))
            .where(F.col("labels") >= 2))


def conflicting_labels(prep: Prepared) -> DataFrame:
    return conflict_groups(prep).groupBy("release_id").agg(
        F.count(F.lit(1)).alias("groups"))


def conflict_evidence(prep: Prepared) -> DataFrame:
    """First k conflicting groups by first row: their first row, the first
    row carrying another label, and the number of labels."""
    k = prep.limits.evidence_per_finding
    if not prep.has_role("label"):
        return evidence_rows(prep.df.limit(0), "conflicting-labels", F.lit(""),
                             detail=F.lit(""), ordinal=F.lit(0))
    top = top_k(conflict_groups(prep), ["release_id"], [F.col("first_row")], k)
    top = bounded_broadcast(top, k * prep.n_releases)
    second = (_label_firsts(prep).join(top, ["release_id", "fp_feature"])
              .where(F.col("first_l") > F.col("first_row"))
              .groupBy("release_id", "fp_feature", "first_row", "labels", "__rank")
              .agg(F.min("first_l").alias("second_row")))
    second = prep.with_role(second, "label")
    return evidence_rows(
        second, "conflicting-labels",
        F.concat_ws(":", F.lit("conflict"), (F.col("first_row") + 1).cast("string"),
                    (F.col("second_row") + 1).cast("string")),
        row=F.col("first_row") + 1, other_row=F.col("second_row") + 1,
        column=F.col("__role"),
        detail=F.concat(F.col("labels").cast("string"),
                        F.lit(" labels stand beside one set of features.")),
        ordinal=F.col("__rank"))


def label_distribution(prep: Prepared) -> DataFrame:
    return prep.memo("label_distribution", lambda: _label_distribution(prep))


def _label_distribution(prep: Prepared) -> DataFrame:
    """Rows per normalised label (NULL is the class ``null``, ``''`` is
    ``(empty)``), numbered by first appearance as neutral ``class-NN``
    tokens; label text never leaves this operator."""
    if not prep.has_role("label"):
        return empty_frame(prep.df.sparkSession, "release_id string, category string, count bigint, class_index bigint")
    lab = F.when(F.col("label_norm") == "", F.lit("(empty)")).otherwise(F.col("label_norm"))
    counts = (prep.df.where(F.col("label_norm").isNotNull()).groupBy("release_id", lab.alias("__label"))
              .agg(F.count(F.lit(1)).alias("count"), F.min("_row").alias("__first")))
    numbered = with_row_number(counts, [F.col("__first")], group="release_id", name="__idx",
                               max_groups=prep.n_releases)
    idx = (F.col("__idx") + 1).cast("string")
    return numbered.select(
        "release_id",
        F.concat(F.lit("class-"), F.lpad(idx, F.greatest(F.lit(2), F.length(idx)), "0"))
        .alias("category"),
        F.col("count").cast("bigint").alias("count"),
        (F.col("__idx") + 1).alias("class_index"))


def class_shares(prep: Prepared) -> DataFrame:
    """Per release: rows, classes, largest and smallest class share."""
    rows = prep.df.groupBy("release_id").agg(F.count(F.lit(1)).alias("rows"))
    dist = (label_distribution(prep).groupBy("release_id")
            .agg(F.count(F.lit(1)).alias("classes"), F.max("count").alias("largest"),
                 F.min("count").alias("smallest")))
    return (dist.join(rows, "release_id")
            .withColumn("majority_share", F.col("largest") / F.col("rows"))
            .withColumn("minority_share", F.col("smallest") / F.col("rows")))


def class_imbalance(prep: Prepared) -> DataFrame:
    s = class_shares(prep)
    fires = ((F.col("rows") >= IMBALANCE_MIN_ROWS) & (F.col("classes") >= 2)
             & ((F.col("majority_share") > IMBALANCE_MAJORITY)
                | (F.col("minority_share") < IMBALANCE_MINORITY)))
    return s.withColumn("imbalanced", fires)


def label_findings(prep: Prepared) -> tuple[DataFrame, DataFrame]:
    groups = conflicting_labels(prep)
    f_conf = finding_rows(groups, "conflicting-labels", F.col("groups"), F.concat(
        F.lit("Features labelled in more than one way: "), F.col("groups").cast("string"),
        plural(F.col("groups"), " group.", " groups.")))
    imb = class_imbalance(prep).where("imbalanced")
    f_imb = finding_rows(imb, "class-imbalance", F.lit(1),
                         F.lit("One class holds too much or too little of the rows."))
    e_imb = evidence_rows(
        prep.with_role(imb, "label"), "class-imbalance", F.lit("imbalance:label-distribution"),
        column=F.col("__role"),
        detail=F.concat(F.lit("Share of the most frequent class: "), percent_text(F.col("majority_share")),
                        F.lit("%, of the rarest: "), percent_text(F.col("minority_share")),
                        F.lit("%.")),
        ordinal=F.lit(1))
    return f_conf.unionByName(f_imb), conflict_evidence(prep).unionByName(e_imb)
