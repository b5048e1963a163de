"""Audited views over the driver's test tables.

``documents`` is the audited table, with all its columns: ordered by ``doc_id``;
``split`` is ``test`` when ``doc_id % 5 = 0`` else ``train``; ``label`` is
``labels.quality`` through a left join (NULL stays a class).  Roles: id =
doc_id, split = split, label = label; the features are ``text``, ``lang``, ``source``
and ``n_chars``.  Leakage and conflicting labels are also asked of the texts alone
(``texts_prepared``).

Releases for the multi-release audit are derived from the same table: one
release per document ``source``, its provenance the source name and its
license the first license statement line found in that source's
documents (by doc_id), blank when none is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Limits, Release, Roles
from ..operators.prepare import Prepared, prepare, regroup
from ..plans.audit import AuditResult, audit

DOCS_RELEASE = Release(release_id="documents", dataset_name="documents",
                       provenance="documents table", license="see per-source releases",
                       label_column="label", split_column="split", id_column="doc_id")
DOCS_ROLES = Roles(label="label", split="split", id="doc_id")
LICENSE_LINE = r"(?m)^[^\n]*[Ll]icen[cs]e[^\n]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_view(spark: SparkSession, sf_dir: str, with_source: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    cols = [*(F.col(c) for c in docs.columns),
            F.when(F.col("doc_id") % 5 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
            F.col("label")]
    if with_source:  # beside the audited column, for regrouping
        cols.append(F.col("source").alias("__source"))
    return docs.join(labels, "doc_id", "left").select(*cols)


def order_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers derived from ``orders``, as numbers and as text: a phone number,
    and twelve digits that begin with a date whose month may be none."""
    date, key = F.col("o_orderdate"), F.col("o_orderkey")
    day = (F.year(date) % 100) * 10_000 + (key % 15) * 100 + F.dayofmonth(date)
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), (F.lit(60_110_000_000) + key % 10_000_000).alias("contact"),
        (day * 1_000_000 + F.col("o_custkey") % 1_000_000).cast("bigint").alias("holder"),
        F.concat_ws("-", F.lpad(day.cast("string"), 6, "0"), F.lit("14"),
                    F.lpad((F.col("o_custkey") % 10_000).cast("string"), 4, "0")).alias("holder_text"))


def source_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # cheap literal guard first; the anchored pattern is linear per line
    line = F.when(F.instr(F.col("text"), "icen") > 0,
                  F.regexp_extract(F.col("text"), LICENSE_LINE, 0)).otherwise(F.lit(""))
    return (docs.select("source", "doc_id", line.alias("line"))
            .groupBy("source")
            .agg(F.min_by(F.when(F.col("line") != "", F.col("line")),
                          F.when(F.col("line") != "", F.col("doc_id"))).alias("license"))
            .select(F.col("source").alias("release_id"), F.col("source").alias("dataset_name"),
                    F.col("source").alias("provenance"),
                    F.coalesce(F.col("license"), F.lit("")).alias("license"),
                    F.lit("").alias("purpose"), F.lit("label").alias("label_column"),
                    F.lit("split").alias("split_column"), F.lit("doc_id").alias("id_column")))


# ---------------------------------------------------------------------------
# Cached audits (one prepared table per session, data folder and mode)
# ---------------------------------------------------------------------------

_CACHE: dict = {}


def _key(spark: SparkSession, sf_dir: str, what: str):
    return (spark.sparkContext.applicationId, sf_dir, what)


def documents_prepared(spark: SparkSession, sf_dir: str, limits: Limits = Limits()) -> Prepared:
    key = _key(spark, sf_dir, ("prep", limits.token_limit))
    if key not in _CACHE:
        _CACHE[key] = prepare(documents_view(spark, sf_dir, with_source=True),
                              release_id="documents", roles=DOCS_ROLES, limits=limits,
                              order_by=[F.col("doc_id")], carry=("__source",))
    base = _CACHE[key]
    return base if base.limits == limits else base.with_limits(limits)


def texts_prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    """The documents' texts with id, split and label: rows that repeat a text count as
    equal whatever their source.  Leakage and conflicts are asked of these."""
    key = _key(spark, sf_dir, "texts")
    if key not in _CACHE:
        _CACHE[key] = prepare(documents_view(spark, sf_dir).select("doc_id", "text", "split", "label"),
                              release_id="documents", roles=DOCS_ROLES, order_by=[F.col("doc_id")], cells=False)
    return _CACHE[key]


def rows_prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    """The documents for detectors that ask for no token sets and no identifiers: the prepared
    table of the others if there is one, else one without these columns."""
    whole = _CACHE.get(_key(spark, sf_dir, ("prep", Limits().token_limit)))
    if whole is not None:
        return whole
    key = _key(spark, sf_dir, "rows")
    if key not in _CACHE:
        _CACHE[key] = prepare(documents_view(spark, sf_dir), release_id="documents", roles=DOCS_ROLES,
                              order_by=[F.col("doc_id")], cells=False)
    return _CACHE[key]


def documents_audit(spark: SparkSession, sf_dir: str, limits: Limits = Limits()) -> AuditResult:
    key = _key(spark, sf_dir, ("audit", limits))
    if key not in _CACHE:
        prep = documents_prepared(spark, sf_dir, limits)
        _CACHE[key] = audit(prep.df, DOCS_RELEASE, prepared=prep, limits=limits)
    return _CACHE[key]


def sources_audit(spark: SparkSession, sf_dir: str, limits: Limits = Limits()) -> AuditResult:
    """Every source a release of its own, audited in one job."""
    key = _key(spark, sf_dir, ("sources", limits))
    if key not in _CACHE:
        # the documents' prepared table, regrouped by source: no second pass
        # over the raw text
        prep = regroup(documents_prepared(spark, sf_dir, limits), "__source")
        _CACHE[key] = audit(prep.df, source_releases(spark, sf_dir), prepared=prep,
                            limits=limits)
    return _CACHE[key]


def clear_cache() -> None:
    for v in _CACHE.values():
        df = v.df if isinstance(v, Prepared) else v.findings
        try:
            df.unpersist()
        except Exception:
            pass
    _CACHE.clear()
