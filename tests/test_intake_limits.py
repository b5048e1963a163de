"""Limits that are refused before an audit starts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tollgate import Limits, Release, audit
from tollgate.sources import readers
from tollgate.sources.validate import IntakeError


def test_bytes_are_refused_before_any_row_is_read(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n" + "1,2\n" * 100 + '"never closed')
    for place in (path, tmp_path):
        with pytest.raises(IntakeError, match="exceeds 200 bytes"):
            readers.read_dataset(spark, str(place), "csv", Limits(bytes=200))
    path.write_text("a,b\n1,2\n")
    assert readers.read_dataset(spark, str(path), None, Limits(bytes=200)).count() == 1


def test_audit_refuses_long_metadata(spark):
    df = spark.createDataFrame([("1", "x", "a", "train")], "id string, feature string, label string, split string")
    with pytest.raises(IntakeError, match="Release r: purpose exceeds 500"):
        audit(df, Release(release_id="r", purpose="p" * 501), order_by=[F.col("id")])
    with pytest.raises(IntakeError, match="Release b: license exceeds 500"):
        rows = [("a", "d", "p", "l"), ("b", "d", "p", "l" * 501)]
        audit(df.withColumn("rel", F.lit("a")), spark.createDataFrame(rows, "release_id string, dataset_name string, provenance string, license string"),
              release_col="rel", order_by=[F.col("id")])
    audit(df, Release(release_id="r", purpose="p" * 500, provenance="o", license="o"), order_by=[F.col("id")]).summary.collect()
