"""URL filter as a sort-merge range join [native].

A host is keyed by its labels in reverse (``blog.example.net`` is
``net.example.blog.``), so a rule's host and all its subdomains are one
interval of keys: ``net.example.`` up to, but without, ``net.example/``
(``/`` follows ``.`` in byte order and never occurs in a host).  Such intervals
are nested or disjoint.  Each boundary therefore has a stack of the rules
active after it: at a start the rules of the host and of its parents, at an end
those of the parents.  URLs and boundaries are sorted together and the sweep
carries the stack of the last boundary to each URL; among its rules whose path
starts the URL's path, the longest decides.

The sweep is dealt out by (top label, salt): no interval crosses a top label,
URLs are spread over the salts whatever their host, and the few boundaries are
copied to every salt.  So a host with a third of all URLs is split evenly.

Defined results: a null url, or one without ``://``, has empty host and path
and the verdict for unusable addresses; repeated rows and ids stay as they are;
other columns are ignored; an empty table gives an empty result; an empty rule
table gives the default verdict everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import fold_case

#: (host, path, verdict) of the rules to report.  Fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: The method's own rules: they decide where no rule above fits.
OWN_RULES = [("spam-farm.example.org", "/", "block"), ("ads-track.example.com", "/", "block"),
             ("cheap-pills.example.com", "/", "block")]

DEFAULT, UNUSABLE = "allow", "block"


def rule_table(spark: SparkSession, rules=RULES, own=OWN_RULES) -> DataFrame:
    rows = [(h, p, v, True) for h, p, v in rules] + [(h, p, v, False) for h, p, v in own]
    return spark.createDataFrame(rows, "host string, path string, verdict string, named boolean")


def host_of(url: Column) -> Column:
    return fold_case(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, top, stack) for each start and end of a rule host's interval."""
    r = rules.select(F.concat_ws(".", _labels(F.col("host"))).alias("node"),
                     F.struct(F.col("named"), (F.length("host") + F.length("path")).alias("size"),
                              F.concat("host", "path").alias("rule"), F.col("path").alias("prefix"),
                              F.col("verdict")).alias("r"))
    nodes = r.select("node").distinct().select(
        "node", F.explode(F.expr("transform(sequence(1, size(split(node, '[.]'))), "
                                 "i -> concat_ws('.', slice(split(node, '[.]'), 1, i)))")).alias("up"))
    ups = (nodes.join(r.withColumnRenamed("node", "up"), "up")
           .groupBy("node").agg(F.collect_set(F.struct("up", "r")).alias("all")))
    stack = F.transform("all", lambda x: x["r"])
    outer = F.transform(F.filter("all", lambda x: x["up"] != F.col("node")), lambda x: x["r"])
    top = F.split("node", "[.]")[0].alias("top")
    return (ups.select(F.concat("node", F.lit(".")).alias("key"), top, stack.alias("stack"))
            .unionByName(ups.select(F.concat("node", F.lit("/")).alias("key"), top, outer.alias("stack"))))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          salts: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``urls``."""
    spark = urls.sparkSession
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    host = host_of(F.col(url_col))
    keyed = urls.select(F.col(id_col).alias("id"), host.alias("host"), path_of(F.col(url_col)).alias("path"),
                        F.pmod(F.xxhash64(F.col(id_col), F.col(url_col)), F.lit(salts)).alias("salt"))
    labels = _labels(F.col("host"))
    rows = keyed.select("id", "host", "path", F.concat(F.concat_ws(".", labels), F.lit(".")).alias("key"),
                        labels[0].alias("top"), "salt", F.lit(1).alias("turn"))
    marks = boundaries(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) \
        .withColumn("salt", F.col("salt").cast("long")).withColumn("turn", F.lit(0))
    sweep = Window.partitionBy("top", "salt").orderBy("key", "turn") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = (rows.unionByName(marks, allowMissingColumns=True)
             .withColumn("active", F.last(F.when(F.col("turn") == 0, F.col("stack")), ignorenulls=True).over(sweep))
             .where("turn = 1"))
    # named rules go before the method's own, then the longest; one rule given twice: block
    best = F.array_max(F.filter("active", lambda r: F.startswith(F.col("path"), r["prefix"])))
    return (swept.withColumn("best", best).select(
        F.col("id").alias(id_col), "host", "path",
        F.when(F.col("best.named"), F.col("best.rule")).alias("rule"),
        F.coalesce(F.col("best.verdict"),
                   F.when(F.col("host") == "", F.lit(UNUSABLE)).otherwise(F.lit(DEFAULT))).alias("verdict")))


#: The same rows in DuckDB.
ORACLE = """
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(h, p, verdict, named) as (values ('net', '/', 'block', true), ('example.net', '/en/', 'allow', true),
  ('example.com', '/de/', 'block', true), ('org', '/fr/', 'allow', true),
  ('spam-farm.example.org', '/', 'block', false), ('ads-track.example.com', '/', 'block', false),
  ('cheap-pills.example.com', '/', 'block', false)),
m as (
  select u.page_id, u.host, u.path, r.*, row_number() over (partition by u.page_id, u.host, u.path
           order by r.named desc nulls last, length(r.h || r.p) desc) as k
  from u left join r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p))
select page_id, host, path, case when named then h || p end as rule,
       coalesce(verdict, case when host = '' then 'block' else 'allow' end) as verdict
from m where k = 1
"""
