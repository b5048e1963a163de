"""Dataset, configuration and report hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DETECTOR_VERSION, LIMITATIONS, METADATA_FIELDS, SCHEMA_VERSION
from .governance import clean_releases

#: Fan-in of the dataset hash tree: rows per leaf chunk, chunks per node.
HASH_FAN_IN = 65_536


def dataset_fingerprint(prep_df: DataFrame, fan_in: int = HASH_FAN_IN) -> DataFrame:
    """Order-sensitive SHA-256 of all raw rows, as a hash tree.

    Leaves hash ``fan_in`` consecutive row hashes; each level hashes
    ``fan_in`` consecutive hashes of the level below, until one per release
    is left.  No group ever holds more than ``fan_in`` items, and the value
    depends only on the rows and their order, not on partitioning.
    """
    level = prep_df.select("release_id", F.col("_row").alias("idx"), F.col("row_hash").alias("h"))
    max_idx = level.agg(F.max("idx")).first()[0] or 0
    while True:
        level = (level.groupBy("release_id", F.floor(F.col("idx") / fan_in).alias("idx"))
                 .agg(F.sha2(F.expr("listagg(h, '') within group (order by idx)"), 256)
                      .alias("h")))
        max_idx //= fan_in
        if max_idx == 0:
            break
    return level.select("release_id", F.col("h").alias("dataset_hash"))


def configuration_hash(releases: DataFrame) -> DataFrame:
    """SHA-256 of the stable (key-sorted, compact) JSON of schema version,
    metadata and detector version."""
    r = clean_releases(releases)
    meta = F.struct(
        F.col("dataset_name").alias("datasetName"), F.col("id_column").alias("idColumn"),
        F.col("label_column").alias("labelColumn"), F.col("license").alias("license"),
        F.col("provenance").alias("provenance"), F.col("purpose").alias("purpose"),
        F.col("split_column").alias("splitColumn"))
    body = F.to_json(F.struct(F.lit(DETECTOR_VERSION).alias("detector"), meta.alias("metadata"),
                              F.lit(SCHEMA_VERSION).alias("schemaVersion")))
    return r.select("release_id", F.sha2(body, 256).alias("configuration_hash"))


def report_hash(releases: DataFrame, summary: DataFrame, findings: DataFrame, evidence: DataFrame,
                hashes: DataFrame) -> DataFrame:
    """SHA-256 over the ordered findings with their evidence, the summary, the
    metadata, the limitations, the schema version and the two input hashes;
    excludes time and the rendered card.  Each release holds at most 11
    findings of at most k evidence items, so the lists are bounded."""
    ev = (evidence.groupBy("release_id", "finding_id")
          .agg(F.array_sort(F.collect_list(F.struct(
              "ordinal", "key", "row", "other_row", "column", "masked_value", "detail")))
              .alias("evidence")))
    f = (findings.join(ev, ["release_id", "finding_id"], "left")
         .groupBy("release_id")
         .agg(F.array_sort(F.collect_list(F.struct(
             "ordinal", "finding_id", "type", "severity", "title", "summary", "count",
             "remediation", "evidence"))).alias("findings")))
    s = summary.select("release_id", F.struct(*[c for c in summary.columns if c != "release_id"])
                       .alias("summary"))
    meta = clean_releases(releases).select("release_id", F.struct(*METADATA_FIELDS).alias("metadata"))
    core = (s.join(f, "release_id", "left").join(hashes, "release_id", "left").join(meta, "release_id", "left")
            .withColumn("limitations", F.array(*[F.lit(x) for x in LIMITATIONS]))
            .withColumn("schema_version", F.lit(SCHEMA_VERSION)))
    body = F.to_json(F.struct("schema_version", "dataset_hash", "configuration_hash", "metadata", "summary",
                              "findings", "limitations"))
    return core.select("release_id", F.sha2(body, 256).alias("report_hash"))


def table_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of any table with a key, such as a set of expected results: rows
    in the order of their keys, hashed as a tree."""
    from .rows import with_row_number

    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    hashed = df.select(F.lit("table").alias("release_id"), row.alias("row_hash"), *[F.col(f"`{k}`") for k in keys])
    numbered = with_row_number(hashed, [F.col(f"`{k}`") for k in keys] + [F.col("row_hash")])
    return dataset_fingerprint(numbered).select(F.col("dataset_hash").alias("table_hash"))
