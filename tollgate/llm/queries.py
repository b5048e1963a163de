"""The queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations, gru_lm, hard_negatives, html_paths, jaccard_join, langid_kn, license_scan, packing, piece_bpe, pii_gbt, pstable, spaced_seeds, url_rules
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and expressions in every whole text of ``documents``."""
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every whole text of ``documents`` under shingle similarity."""
    return jaccard_join.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-likelihood of every whole text of ``documents``."""
    return gru_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pstable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every ``embeddings`` vector."""
    return pstable.link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every ``pages`` row."""
    return html_paths.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid_kn.identify(docs, langid_kn.fit(docs))


def op8_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return pii_gbt.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the rules on every ``pages`` url."""
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.rule_table(spark))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` row that holds a passage of a ``benchmark`` item."""
    return spaced_seeds.find(table(spark, sf_dir, "documents").select("doc_id", "text"),
                             table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases in all whole texts of ``documents``."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors of ``embeddings``, from all its rows."""
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the piece ids and of the text they decode to, of every whole text of ``documents``."""
    return piece_bpe.digests(piece_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {q.__name__: q for q in (op1_license_scan, op2_jaccard_join, op3_gru_scores, op4_pstable_dedup, op5_host_paths, op6_vector_packing, op7_language_id, op8_pii_boosted,
                                   op9_url_rules, op10_spaced_seeds, op11_collocations,
                                   op12_hard_negatives, op13_piece_bpe)}

ORACLE_SQL = {"op2_jaccard_join": jaccard_join.ORACLE, "op9_url_rules": url_rules.ORACLE,
              "op11_collocations": collocations.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
