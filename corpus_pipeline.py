"""A training corpus from ``documents`` in stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and reread as the next stage's docs.  All but the last return the
columns of ``documents``.

Every stage takes tables with null or repeated ids, null, empty and very long
texts, repeated rows and any further columns, whatever their names, which it
carries; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tollgate.llm import jaccard_join, langid_kn, packing, pii_gbt, spaced_seeds
from tollgate.llm.common import table
from tollgate.session import ensure_checkpoint_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay: rows whose text the models reject go, and so do
    rows without a letter (null and empty texts among them), which have no language.  Equal texts fare
    alike; without any labelled text nothing is known and nothing stays."""
    return langid_kn.keep_known(docs, langid_kn.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the first by id, rows without an id last, then by a
    hash of the text; one of those equal in both, whatever their other columns.  Rows without words
    are in no group and all stay."""
    return jaccard_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark stay, null and empty texts among them.  It goes by
    rows: of two that share an id only the one that holds a passage goes."""
    return spaced_seeds.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; its personal data become bracketed kinds, and ``n_chars`` the new text's length.
    A null text stays null (its ``n_chars`` too); where spans overlap, the first one's kind is written."""
    return pii_gbt.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in sequences of tokens, a null or empty text as its closing id alone; equal rows are
    packed each."""
    return packing.pack_documents(docs)


STAGES = [("language_id", known_language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("personal_data", redact_personal_data), ("packing", pack)]

#: The models of the stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's frame for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    root = ensure_checkpoint_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{root}/pipeline-{k}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
