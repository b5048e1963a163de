"""Prediction keys from findings, scoring against gold keys, and
clean rows flagged.  Keys have the form ``case|category|...``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORIES
from ..functions.literals import literal_frame


def prediction_keys(findings: DataFrame, evidence: DataFrame, row_ids: DataFrame,
                    case_col: str = "release_id") -> DataFrame:
    """(case_id, category, key) with set semantics.

    ``row_ids`` maps (release_id, row) -> id_text (1-based rows).  PII keys
    carry the row id and column; pair findings carry the sorted ids of both
    rows; imbalance carries the label column; metadata findings carry
    ``metadata``.
    """
    f = findings.select("release_id", "finding_id", "category")
    e = evidence.join(f, ["release_id", "finding_id"])
    ids = _named_rows(evidence, row_ids)
    a = ids.select("release_id", F.col("row").alias("row"), F.col("id_text").alias("id_a"))
    b = ids.select("release_id", F.col("row").alias("other_row"), F.col("id_text").alias("id_b"))
    e = e.join(a, ["release_id", "row"], "left").join(b, ["release_id", "other_row"], "left")
    rid_a = F.when(F.col("row").isNull(), F.lit(None)).otherwise(
        F.coalesce(F.col("id_a"), F.concat(F.lit("row-"), F.col("row").cast("string"))))
    rid_b = F.when(F.col("other_row").isNull(), F.lit(None)).otherwise(
        F.coalesce(F.col("id_b"), F.concat(F.lit("row-"), F.col("other_row").cast("string"))))
    pair_ids = F.array_join(F.array_sort(F.filter(F.array(rid_a, rid_b),
                                                  lambda x: x.isNotNull() & (x != ""))), "|")
    cat = F.col("category")
    tail = (F.when(cat == "class-imbalance", F.coalesce(F.col("column"), F.lit("label")))
            .when(cat.isin("missing-provenance", "missing-license"), F.lit("metadata"))
            .when(cat.startswith("pii-"), F.concat_ws(
                "|", F.coalesce(rid_a, F.lit("null")), F.coalesce(F.col("column"), F.lit("unknown"))))
            .otherwise(pair_ids))
    return (e.select(F.col(case_col).alias("case_id"), cat.alias("category"),
                     F.concat_ws("|", F.col(case_col), cat, tail).alias("key"))
            .dropDuplicates(["case_id", "key"]))


def _named_rows(evidence: DataFrame, row_ids: DataFrame) -> DataFrame:
    """Only the row ids that evidence names.  The list grows with the number of
    releases, so the planner decides by its size whether it is broadcast."""
    named = (evidence.select("release_id", F.explode(F.array("row", "other_row")).alias("row"))
             .where(F.col("row").isNotNull()).distinct())
    return row_ids.select("release_id", "row", "id_text").join(named, ["release_id", "row"])


def _categories(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, [(c, i + 1) for i, c in enumerate(CATEGORIES)],
                                 "category string, category_order int")


def _joined(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    p = predicted.select("case_id", "category", "key").dropDuplicates(["case_id", "key"])
    g = gold.select("case_id", "category", "key").dropDuplicates(["case_id", "key"])
    j = (p.withColumn("__p", F.lit(True)).join(
        g.withColumn("__g", F.lit(True)).withColumnRenamed("category", "__gcat"),
        ["case_id", "key"], "full"))
    return j.select("case_id", F.coalesce("category", "__gcat").alias("category"),
                    F.coalesce("__p", F.lit(False)).alias("p"),
                    F.coalesce("__g", F.lit(False)).alias("g"))


COUNTS = ("expected", "matched", "unexpected", "missed")


def score_levels(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(level, case_id, category, counts): expected, matched, unexpected and missed
    keys by case, by category and overall, as grouping sets over one join."""
    tallied = _joined(predicted, gold).groupingSets([["case_id"], ["category"], []], "case_id", "category").agg(
        F.grouping("case_id").alias("no_case"), F.grouping("category").alias("no_category"),
        F.count_if(F.col("g")).alias("expected"),
        F.count_if(F.col("p") & F.col("g")).alias("matched"),
        F.count_if(F.col("p") & ~F.col("g")).alias("unexpected"),
        F.count_if(~F.col("p") & F.col("g")).alias("missed"))
    level = F.when(F.col("no_case") == 0, "case").when(F.col("no_category") == 0, "category").otherwise("overall")
    return tallied.select(level.alias("level"), "case_id", "category", *COUNTS)


def score_by_case(predicted: DataFrame, gold: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """expected / matched / unexpected / missed per case (cases without any
    key are kept with zeros when ``cases`` is given)."""
    return case_scores(score_levels(predicted, gold), cases)


def score_by_category(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """The same counts for each of the eleven categories (zero rows kept)."""
    return category_scores(score_levels(predicted, gold))


def score_overall(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    return overall_scores(score_levels(predicted, gold))


def case_scores(levels: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    t = levels.where("level = 'case'").select("case_id", *COUNTS)
    if cases is not None:
        t = cases.select("case_id").distinct().join(t, "case_id", "left").na.fill(0)
    return t


def category_scores(levels: DataFrame) -> DataFrame:
    t = levels.where("level = 'category'").select("category", *COUNTS)
    return (_categories(levels.sparkSession).join(t, "category", "left").na.fill(0)
            .orderBy("category_order").drop("category_order"))


def overall_scores(levels: DataFrame) -> DataFrame:
    return levels.where("level = 'overall'").select(*COUNTS)


def clean_rows_flagged(evidence: DataFrame, row_ids: DataFrame,
                       control: DataFrame | None = None) -> DataFrame:
    """Distinct row ids named by any evidence, per release (optionally only
    the releases listed in ``control``)."""
    e = evidence
    if control is not None:
        e = e.join(control.select("release_id"), "release_id", "left_semi")
    rows = (e.select("release_id", F.explode(F.array("row", "other_row")).alias("row"))
            .where(F.col("row").isNotNull()))
    named = (rows.join(_named_rows(e, row_ids), ["release_id", "row"], "left")
             .select("release_id", F.coalesce("id_text", F.concat(F.lit("row-"), F.col("row")
                                                                  .cast("string"))).alias("rid")))
    return named.groupBy("release_id").agg(F.count_distinct("rid").alias("clean_rows_flagged"))
