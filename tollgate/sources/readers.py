"""Reading CSV, JSON and Parquet into audited DataFrames.

CSV cells are always text (no inference); JSON keeps numbers, booleans and
NULL; Parquet and tables are native.  Headers are normalised and checked
(S4, S5) on the driver from the first record; rows never pass through it.

Every reader carries each row's place in its source in ``ORDER_COLUMN``, which
audits sort by and never audit: row numbers then do not depend on how files
are packed into tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Limits
from ..functions.text import js_trim
from ..operators.rows import ORDER_COLUMN, scan_order, with_row_number
from ..session import cut_lineage
from .splits import CsvLexer, JsonLexer, pieces, records, split_states
from .validate import (IntakeError, blank_rows_removed, check_bytes, check_columns_scalar, check_limits,
                       json_record_violations, normalize_headers)

# One cell: quoted (adjacent quoted sections are escaped quotes) or without
# quotes.  Possessive throughout, so no input makes the matcher recurse.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",{eol}]*+)'
_RECORD = _CELL + "(?:," + _CELL + ")*+"
LINE_RECORD = r"^\uFEFF?" + _RECORD.format(eol="") + r"\z"


def _csv_reader(spark: SparkSession, multi_line: bool):
    return (spark.read.option("multiLine", multi_line)
            .option("quote", '"').option("escape", '"').option("inferSchema", False)
            .option("mode", "PERMISSIVE"))


def _unquoted(text: Column) -> Column:
    """The text without its quoted sections."""
    return F.regexp_replace(text, '"[^"]*"', "")


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some quoted cell may hold a line break: a line with an odd number
    of quotes."""
    quotes = F.length("value") - F.length(F.regexp_replace("value", '"', ""))
    return bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())


def csv_headers(spark: SparkSession, path: str, multi_line: bool, limits: Limits = Limits()) -> list[str]:
    """The header names as they stand in the first record, checked."""
    first = _csv_reader(spark, multi_line).option("header", False).csv(path).first()
    if first is None:
        raise IntakeError("The dataset has no header.")
    return normalize_headers([c or "" for c in first], limits)


def csv_records(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """(at, value, head): the text of every record with its place in the source, and
    whether it is its file's first.  With ``multi_line``, lines inside quoted cells are
    put together across splits; no file is read as a whole."""
    if not multi_line:
        place = F.struct(F.col("o.file").alias("file"), F.col("o.block").alias("block"), F.col("o.at").alias("at"))
        lines = spark.read.text(path).select(scan_order().alias("o"), F.regexp_replace("value", r"\r$", "").alias("value"))
        first = (F.col("o.block") == 0) & (F.col("o.at").bitwiseAND(F.lit((1 << 33) - 1)) == 0)
        return lines.select(place.alias("at"), "value", first.alias("head"))
    lexer = CsvLexer()
    found = pieces(spark, path, lexer.separator)
    states = cut_lineage(split_states(found, lexer))  # one small row a split
    return records(found, states, lexer).select(
        F.struct("file", "block", "at").alias("at"), F.regexp_replace("text", r"\r?\n\z", "").alias("value"), "head")


def csv_violations(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S8 and quoting: (row, rule) of data rows (1-based, blank rows skipped) that
    hold more cells than the header, a quote inside a cell, or a quoted cell that
    does not end.  Nothing is sorted unless there are any."""
    n = len(csv_headers(spark, path, multi_line))
    return _record_violations(csv_records(spark, path, multi_line), n)


def _record_violations(found: DataFrame, n: int) -> DataFrame:
    cells = F.size(F.split(_unquoted(F.col("value")), ",", -1))
    rule = (F.when(~F.col("value").rlike(LINE_RECORD), F.lit("quote-inside-cell"))
            .when(cells > n, F.lit("too-many-cells")))
    blank = (js_trim(F.translate("value", '",', "")) == "") & (cells <= n)
    rows = found.select("at", rule.alias("rule"), "head", blank.alias("blank")).where(~F.col("blank"))
    if not rows.where(F.col("rule").isNotNull()).limit(1).count():
        return rows.where("false").select(F.lit(0).cast("long").alias("row"), "rule")
    numbered = with_row_number(rows.select("at", "rule"), [F.col("at")])
    return numbered.where(F.col("rule").isNotNull()).select(F.col("_row").alias("row"), "rule")


def read_csv(spark: SparkSession, path: str, limits: Limits = Limits(),
             strict: bool = True, multi_line: bool | None = None) -> DataFrame:
    """RFC-style CSV: header row, quoted fields with ``""`` escapes and
    embedded newlines, CRLF; all columns as strings; blank rows dropped and
    missing cells as ''.  ``strict`` refuses rows with more cells than the
    header, stray quotes, tables without rows and cells over the limits, by row
    number only.  ``multi_line`` says whether quoted cells hold line breaks; by
    default a pass over the lines finds out.  Files are read in splits either way."""
    if multi_line is None:
        multi_line = has_line_breaks(spark, path)
    headers = csv_headers(spark, path, multi_line, limits)
    found = csv_records(spark, path, multi_line)
    if strict:
        bad = _record_violations(found, len(headers)).orderBy("row").first()
        if bad is not None:
            raise IntakeError(f"Row {bad.row + 1} has more values than the header." if bad.rule == "too-many-cells"
                              else f"Row {bad.row + 1} has a quote inside a cell, or one that does not end.")
    places = [f"c{i}" for i in range(len(headers))]
    if multi_line:
        ddl = ", ".join(f"{c} string" for c in places)
        parsed = found.where(~F.col("head")).select("at", F.from_csv("value", ddl, {"quote": '"', "escape": '"'}).alias("r"))
        raw = parsed.select(*[F.col("r")[c].alias(h) for c, h in zip(places, headers)], F.col("at").alias(ORDER_COLUMN))
    else:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in places])
        raw = (_csv_reader(spark, False).schema(schema).option("header", True).option("enforceSchema", True).csv(path)
               .select(*[F.col(c).alias(h) for c, h in zip(places, headers)], scan_order().alias(ORDER_COLUMN)))
    out = blank_rows_removed(raw)
    if strict:
        check_limits(out, limits)
    return out


def json_lines_records(spark: SparkSession, path: str) -> DataFrame:
    """(order, cells, text) for a JSON Lines file: each line parsed as
    ``map<string, variant>`` (NULL when the line is not an object)."""
    lines = spark.read.text(path).select(scan_order().alias("order"), "value").where(js_trim(F.col("value")) != "")
    return lines.select("order", F.try_parse_json("value").alias("v"), F.col("value").alias("text")).select(
        "order", F.expr("try_cast(v as map<string,variant>)").alias("cells"), "text")


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """(order, cells, text) for JSON files that hold an array of records, or an object with
    a ``rows`` array.  Arrays are read in splits and put together across their borders;
    an object is one document, so with one each file is parsed by one task."""
    lexer = JsonLexer()
    found = pieces(spark, path, lexer.separator)
    states = cut_lineage(split_states(found, lexer))  # one small row a split
    if states.where("start <> '['").limit(1).count() or states.isEmpty():
        return _json_documents(spark, path)
    got = records(found, states, lexer)
    lead = F.when(F.col("head"), F.lit(r"^\uFEFF?\s*\[\s*(?=\{)")).otherwise(F.lit(r"^\s*,\s*(?=\{)"))
    end = F.when(F.col("head"), F.lit(r"^\uFEFF?\s*\[\s*\]\s*$")).otherwise(F.lit(r"^\s*\]\s*$"))
    body = F.regexp_replace("text", lead, F.lit(""))
    order = F.struct("file", "block", "at").alias("order")
    parts = got.select(order, "head", body.alias("body"), F.try_parse_json(body).alias("v"),
                       (F.col("tail").isNotNull() & F.regexp_like("tail", end)).alias("end"),
                       (F.col("tail").isNotNull() | ~F.regexp_like("text", lead)).alias("odd"), "file")
    # every file ends its array once, and nothing else stands between its records
    wrong = parts.groupBy("file").agg(F.count_if("end").alias("ends"), F.count_if(
        (F.col("odd") & ~F.col("end")) | (~F.col("odd") & F.col("v").isNull())).alias("bad"))
    if wrong.where("ends <> 1 or bad > 0").limit(1).count():
        raise IntakeError("The JSON file is not an array of records or an object with a rows array.")
    return parts.where("not odd").select("order", F.expr("try_cast(v as map<string,variant>)").alias("cells"), F.col("body").alias("text"))


def _json_documents(spark: SparkSession, path: str) -> DataFrame:
    """The same for files parsed as a whole, one a task."""
    kind = "array<string>"
    text = spark.read.text(path, wholetext=True).select(scan_order().alias("file"), "value", F.try_parse_json("value").alias("v"))
    rows = F.coalesce(F.expr("try_cast(v as array<variant>)"),
                      F.expr("try_cast(try_variant_get(v, '$.rows', 'variant') as array<variant>)"))
    if text.select(rows.alias("r")).where("r is null").limit(1).count():
        raise IntakeError("The JSON file is not an array of records or an object with a rows array.")
    raw = F.coalesce(F.from_json("value", kind), F.from_json("value", f"struct<rows:{kind}>")["rows"])
    return text.select("file", raw.alias("raw"), F.posexplode(rows).alias("pos", "v")).select(
        F.struct(F.col("file.file").alias("file"), F.col("file.block").alias("block"),
                 F.col("pos").cast("long").alias("at")).alias("order"),
        F.expr("try_cast(v as map<string,variant>)").alias("cells"), F.get("raw", F.col("pos")).alias("text"))


def _numbered(records: DataFrame) -> DataFrame:
    return with_row_number(records, [F.col("order")]).select((F.col("_row") + 1).alias("row"), "cells")


def _first_keys(found: DataFrame) -> list[str]:
    """The keys of the first record as they stand in it (a variant sorts them)."""
    first = found.orderBy("order").select(F.json_object_keys("text").alias("keys")).first()
    if first is None:
        raise IntakeError("The dataset has no data rows.")
    if not first["keys"]:
        raise IntakeError("Row 1 must be an object with at least one column.")
    return list(first["keys"])


def read_json(spark: SparkSession, path: str, limits: Limits = Limits(),
              lines: bool = False) -> DataFrame:
    """A top-level array of records, an object with a ``rows`` array, or
    (``lines=True``, the scalable form) one record per line.  Columns are named
    and ordered as in the first record; other records match them ignoring case
    and outer spaces."""
    found = json_lines_records(spark, path) if lines else json_array_records(spark, path)
    headers = normalize_headers(_first_keys(found), limits)
    wanted = F.array_sort(F.array(*[F.lit(h.lower()) for h in headers]))
    keys = F.array_sort(F.transform(F.map_keys("cells"), lambda k: F.lower(js_trim(F.ltrim(k, F.lit("\ufeff"))))))
    nested = F.exists(F.map_values("cells"), lambda v: F.schema_of_variant(v).startswith("OBJECT")
                      | F.schema_of_variant(v).startswith("ARRAY"))
    wrong = F.col("cells").isNull() | (keys != wanted) | nested
    # rows are numbered, and so sorted, only where one is to be refused
    if found.where(F.coalesce(wrong, F.lit(True))).limit(1).count():
        bad = json_record_violations(_numbered(found)).orderBy("row").first()
        if bad is not None:
            raise IntakeError(f"Row {bad.row} breaks the record rules ({bad.rule}).")
        raise IntakeError("A row does not match the columns of the first.")
    named = F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(
        F.lower(js_trim(F.ltrim(e["key"], F.lit("\ufeff")))).alias("key"), e["value"].alias("value"))))
    cells = found.select("order", named.alias("m"))
    places = [F.col("m")[h.lower()] for h in headers]
    kinds = cells.agg(*[F.schema_of_variant_agg(c).alias(f"k{i}") for i, c in enumerate(places)]).first()
    types = [_json_type(kinds[f"k{i}"]) for i in range(len(headers))]
    out = cells.select(*[F.try_variant_get(c, "$", t).alias(h) for c, t, h in zip(places, types, headers)],
                       F.col("order").alias(ORDER_COLUMN))
    doubles = [F.count_if(F.isnan(F.col(f"`{h}`")) | (F.abs(F.col(f"`{h}`")) == float("inf"))).alias(f"d{i}")
               for i, (h, t) in enumerate(zip(headers, types)) if t == "double"]
    if doubles and any(out.agg(*doubles).first()):
        raise IntakeError("A number is not finite.")
    check_limits(out, limits)
    return out


def _json_type(kind: str) -> str:
    """The column type for what a column's values have in common."""
    if kind in ("BIGINT", "BOOLEAN"):
        return kind.lower()
    if kind.startswith("DECIMAL") or kind in ("DOUBLE", "FLOAT"):
        return "double"
    return "string"


def read_parquet(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Parquet under its normalised column names; nested columns are refused."""
    df = spark.read.parquet(path)
    headers = normalize_headers(df.columns, limits)
    check_columns_scalar(df)
    return df.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(df.columns, headers)],
                     scan_order().alias(ORDER_COLUMN))


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None,
                 limits: Limits = Limits()) -> DataFrame:
    """Dispatch on ``fmt`` or the file extension: csv, json, jsonl, parquet."""
    kind = (fmt or path.rsplit(".", 1)[-1]).lower()
    check_bytes(spark, path, limits)
    if kind == "csv":
        return read_csv(spark, path, limits)
    if kind == "json":
        return read_json(spark, path, limits)
    if kind in ("jsonl", "ndjson"):
        return read_json(spark, path, limits, lines=True)
    if kind == "parquet":
        return read_parquet(spark, path, limits)
    raise IntakeError("Choose a .csv, .json, .jsonl or .parquet source.")
