"""Gate roll-up, summary, and the evidence cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import top_k


def gate_status(releases: DataFrame, findings: DataFrame) -> DataFrame:
    """BLOCK if any blocking finding group, else WARN if any, else PASS;
    releases without findings pass."""
    counts = findings.groupBy("release_id").agg(
        F.count_if(F.col("severity") == "block").cast("bigint").alias("block_count"),
        F.count_if(F.col("severity") == "warn").cast("bigint").alias("warning_count"))
    r = releases.select("release_id").join(counts, "release_id", "left")
    b = F.coalesce(F.col("block_count"), F.lit(0))
    w = F.coalesce(F.col("warning_count"), F.lit(0))
    return r.select(
        "release_id",
        F.when(b > 0, F.lit("BLOCK")).when(w > 0, F.lit("WARN")).otherwise(F.lit("PASS"))
        .alias("status"),
        b.alias("block_count"), w.alias("warning_count"))


def cap_evidence(evidence: DataFrame, k: int) -> DataFrame:
    """At most k evidence items per (release, finding), in ordinal order;
    finding counts are not touched."""
    capped = top_k(evidence, ["release_id", "finding_id"],
                   [F.col("ordinal"), F.col("row"), F.col("other_row"), F.col("key")], k,
                   "__cap")
    return capped.drop("ordinal").withColumnRenamed("__cap", "ordinal")
