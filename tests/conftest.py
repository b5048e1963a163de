from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tollgate.session import local_session

    s = local_session("4", shuffle_partitions=4, app_name="tollgate-tests")
    yield s
    s.stop()


def frame(spark, rows, columns=None, schema=None):
    """A DataFrame from dict rows (missing keys are NULL); numbers stay
    typed, every other column is a string."""
    import pandas as pd

    if columns is None:
        columns = []
        for r in rows:
            for c in r:
                if c not in columns:
                    columns.append(c)
    if schema is None:
        parts = []
        for c in columns:
            vals = [r.get(c) for r in rows if r.get(c) is not None]
            if vals and all(isinstance(v, bool) for v in vals):
                t = "boolean"
            elif vals and all(isinstance(v, int) and not isinstance(v, bool) for v in vals):
                t = "bigint"
            elif vals and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in vals):
                t = "double"
            else:
                t = "string"
            parts.append(f"`{c}` {t}")
        schema = ", ".join(parts)
    data = [tuple(r.get(c) for c in columns) for r in rows]
    return spark.createDataFrame(data, schema).withColumn("__seq", __import__(
        "pyspark.sql.functions", fromlist=["x"]).monotonically_increasing_id())


def ordered(df):
    from pyspark.sql import functions as F
    return [F.col("__seq")]
