"""Intake checks.  Each check is one aggregate pass (or a
driver-side look at the schema) and reports row, column and rule -- never
the offending value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FORBIDDEN_KEYS, METADATA_FIELDS, Limits
from ..functions.literals import empty_frame
from ..operators.rows import ORDER_COLUMN
from ..functions.text import js_trim, utf16_length

VIOLATION_SCHEMA = "table string, column string, rule string, violations bigint"


class IntakeError(ValueError):
    """A table the gate refuses; the message never holds a cell value."""


def normalize_header(name: str, index: int, limits: Limits = Limits()) -> str:
    """Strip a BOM and outer spaces; refuse empty, over-long or reserved names."""
    header = name.lstrip("﻿").strip()
    if not header:
        raise IntakeError(f"Column {index + 1} has no name.")
    if len(header.encode("utf-16-le")) // 2 > limits.key_characters:
        raise IntakeError(f"Column {index + 1} name is too long.")
    if header.lower() in FORBIDDEN_KEYS:
        raise IntakeError(f"Column {index + 1} name is not allowed.")
    return header


def normalize_headers(names: list[str], limits: Limits = Limits()) -> list[str]:
    """S4 + S5: normalised header names, unique ignoring case."""
    headers = [normalize_header(n, i, limits) for i, n in enumerate(names)]
    lower = [h.lower() for h in headers]
    if len(set(lower)) != len(lower):
        raise IntakeError("Column names must be unique, ignoring letter case.")
    if limits.columns is not None and len(headers) > limits.columns:
        raise IntakeError(f"The dataset exceeds the {limits.columns} column limit.")
    if not headers:
        raise IntakeError("Dataset rows must contain at least one column.")
    return headers


def check_columns_scalar(df: DataFrame) -> None:
    """S10 at schema level: nested columns are refused."""
    for i, f in enumerate(df.schema.fields):
        if f.name != ORDER_COLUMN and isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise IntakeError(f"Column {i + 1} must contain scalar values.")


def _unpivot(df: DataFrame, table_name: str, rule: str, counts: dict) -> DataFrame:
    spark = df.sparkSession
    if not counts:
        return empty_frame(spark, VIOLATION_SCHEMA)
    agg = df.agg(*[c.cast("bigint").alias(f"__v{i}") for i, c in enumerate(counts.values())])
    return _listed(agg, table_name, [(name, rule) for name in counts])


def _listed(agg: DataFrame, table_name: str, names: list[tuple[str, str]]) -> DataFrame:
    """One row for each counted column of a single aggregate row."""
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(table_name).alias("table"), F.lit(name).alias("column"), F.lit(rule).alias("rule"),
                 F.col(f"__v{i}").alias("violations")) for i, (name, rule) in enumerate(names)])))


def cell_limit_violations(df: DataFrame, table_name: str = "dataset",
                          limits: Limits = Limits()) -> DataFrame:
    """Cells over the character limit (UTF-16 units), per string
    column, in one aggregate over the table."""
    counts = {f.name: F.count_if(utf16_length(F.col(f"`{f.name}`")) > limits.cell_characters)
              for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return _unpivot(df, table_name, "cell-characters", counts)


def scalar_violations(df: DataFrame, table_name: str = "dataset") -> DataFrame:
    """Non-NULL nested cells and non-finite numbers, per column."""
    counts, rules = {}, {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            counts[f.name] = F.count_if(c.isNotNull())
            rules[f.name] = "non-scalar"
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            counts[f.name] = F.count_if(F.isnan(c) | (F.abs(c) == float("inf")))
            rules[f.name] = "non-finite"
    if not counts:
        return empty_frame(df.sparkSession, VIOLATION_SCHEMA)
    agg = df.agg(*[v.cast("bigint").alias(f"__v{i}") for i, v in enumerate(counts.values())])
    return _listed(agg, table_name, [(name, rules[name]) for name in counts])


def row_shape_violations(maps: DataFrame, row_col: str = "row",
                         map_col: str = "cells") -> DataFrame:
    """S9/S5 for JSON records read as ``map<string, ...>``: a row whose
    normalised key set (trimmed, lower case) differs from the first row's,
    a row with colliding keys, or a row without keys.  Output: row, rule."""
    keys = F.array_sort(F.transform(F.map_keys(F.col(map_col)), lambda k: F.lower(js_trim(k))))
    k = maps.select(F.col(row_col).alias("row"), keys.alias("keys"))
    # the first row's key set: one value, so no join (Spark folds a constant join key away)
    j = k.withColumn("first_keys", k.orderBy("row").limit(1).select("keys").scalar())
    rule = (F.when(F.size("keys") == 0, F.lit("no-columns"))
            .when(F.size("keys") != F.size(F.array_distinct("keys")), F.lit("colliding-columns"))
            .when(F.col("keys") != F.col("first_keys"), F.lit("schema-mismatch")))
    return j.select("row", rule.alias("rule")).where(F.col("rule").isNotNull())


def metadata_violations(releases: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Metadata fields over the length limit, per release."""
    parts = [releases.where(utf16_length(F.col(f)) > limits.metadata_characters)
             .select("release_id", F.lit(f).alias("field"), F.lit("too-long").alias("rule"))
             for f in METADATA_FIELDS if f in releases.columns]
    return reduce(DataFrame.unionByName, parts)


def blank_rows_removed(df: DataFrame) -> DataFrame:
    """S6 + S7: string cells NULL -> '' and rows whose cells are all blank dropped."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    filled = df.na.fill("", subset=strings) if strings else df
    if not strings:
        return filled
    any_text = reduce(lambda a, b: a | b, [js_trim(F.col(f"`{c}`")) != "" for c in strings])
    return filled.where(any_text)


def json_record_violations(records: DataFrame, row_col: str = "row",
                           map_col: str = "cells") -> DataFrame:
    """S9 + S10 for JSON records parsed as ``map<string, variant>``: the
    shape rules of :func:`row_shape_violations`, lines that are not an
    object, and nested (object or array) cells.  Output: row, rule."""
    parsed = records.where(F.col(map_col).isNotNull())
    not_object = (records.where(F.col(map_col).isNull())
                  .select(F.col(row_col).alias("row"), F.lit("not-an-object").alias("rule")))
    nested = (parsed.where(F.exists(F.map_values(F.col(map_col)), lambda v: (
                  F.schema_of_variant(v).startswith("OBJECT")
                  | F.schema_of_variant(v).startswith("ARRAY"))))
              .select(F.col(row_col).alias("row"), F.lit("non-scalar").alias("rule")))
    return (row_shape_violations(parsed, row_col, map_col)
            .unionByName(not_object).unionByName(nested))


def check_limits(df: DataFrame, limits: Limits = Limits()) -> None:
    """Refuses a table over the row or cell limit, or without rows; one aggregate
    pass, and the message names a column or a number only."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    over = [] if limits.cell_characters is None else [
        F.count_if(utf16_length(F.col(f"`{c}`")) > limits.cell_characters).alias(f"v{i}") for i, c in enumerate(strings)]
    seen = df.agg(F.count(F.lit(1)).alias("n"), *over).first()
    if not seen.n:
        raise IntakeError("The dataset has no data rows.")
    if limits.rows is not None and seen.n > limits.rows:
        raise IntakeError(f"The dataset exceeds the {limits.rows} row limit.")
    for i in range(len(over)):
        if seen[f"v{i}"]:
            raise IntakeError(f"A value in column {i + 1} of the text columns exceeds "
                              f"{limits.cell_characters} characters.")


def check_metadata(releases: DataFrame, limits: Limits = Limits()) -> None:
    """Refuses over-long release metadata, by release and field."""
    bad = metadata_violations(releases, limits).orderBy("release_id", "field").first()
    if bad is not None:
        raise IntakeError(f"Release {bad.release_id}: {bad.field} exceeds {limits.metadata_characters} characters.")


def check_bytes(spark: SparkSession, path: str, limits: Limits = Limits()) -> None:
    """Refuses a source with a file over the byte limit before anything of it
    is read; sizes come from the file system's listing."""
    if limits.bytes is None:
        return
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(sc._jsc.hadoopConfiguration())
    for root in system.globStatus(place) or []:
        files = system.listFiles(root.getPath(), True)
        while files.hasNext():
            found = files.next()
            if found.getLen() > limits.bytes and not found.getPath().getName().startswith(("_", ".")):
                raise IntakeError(f"A file of the dataset exceeds {limits.bytes} bytes.")
