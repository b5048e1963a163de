"""PII cells on a streaming DataFrame.

The PII scan is a stateless per-row projection, so it runs unchanged on a
``readStream`` source: each micro-batch emits one row per (record, column,
kind) with at least one validated match.  Streams have no dense row
numbers, so records are identified by a key column the caller names.
Counts per kind over the whole stream are a plain streaming aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pii import cell_hits


def pii_cell_stream(stream: DataFrame, key_col: str) -> DataFrame:
    """(key, column, kind, matches, masked_value) for every matching cell."""
    columns = [(f.name, f.dataType) for f in stream.schema.fields]
    return (stream.select(F.col(f"`{key_col}`").cast("string").alias("key"),
                          F.explode(cell_hits(columns)).alias("h"))
            .select("key", F.col("h.column").alias("column"), F.col("h.kind").alias("kind"),
                    F.col("h.matches").cast("bigint").alias("matches"),
                    F.concat(F.lit("["), F.col("h.kind"), F.lit(" redacted]"))
                    .alias("masked_value")))


def pii_kind_counts(stream: DataFrame, key_col: str) -> DataFrame:
    """Running cells and matches per kind (use output mode ``complete`` or
    ``update``; the state is one row per kind)."""
    return (pii_cell_stream(stream, key_col).groupBy("kind")
            .agg(F.count(F.lit(1)).alias("cells"), F.sum("matches").alias("matches")))
