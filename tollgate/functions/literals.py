"""Small frames built from literals inside the JVM (no Python worker)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fields(schema: str | T.StructType) -> list[T.StructField]:
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return list(st.fields)


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A DataFrame of the given rows, planned as a local generator."""
    fields = _fields(schema)
    if not rows:
        return spark.range(0).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def empty_frame(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return literal_frame(spark, [], schema)
