"""The stateless PII scan on a file stream equals the batch scan."""

from __future__ import annotations

import os
import shutil

import pytest

from tollgate.streaming.pii_stream import pii_cell_stream, pii_kind_counts

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_stream_matches_batch(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/pages.parquet")
    batch = {(r.key, r.column, r.kind, r.matches)
             for r in pii_cell_stream(src, "page_id").collect()}
    folder = tmp_path / "src"  # a file stream reads a folder
    folder.mkdir()
    shutil.copy(f"{SF}/pages.parquet", folder / "part-0.parquet")
    stream = spark.readStream.schema(src.schema).parquet(str(folder))
    q = (pii_cell_stream(stream, "page_id").writeStream.format("memory")
         .queryName("pii_cells_stream").option("checkpointLocation", str(tmp_path / "c1"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {(r.key, r.column, r.kind, r.matches)
           for r in spark.sql("select * from pii_cells_stream").collect()}
    assert got == batch and len(got) > 0
    q2 = (pii_kind_counts(stream, "page_id").writeStream.format("memory").outputMode("complete")
          .queryName("pii_kinds_stream").option("checkpointLocation", str(tmp_path / "c2"))
          .trigger(availableNow=True).start())
    q2.awaitTermination(120)
    kinds = {r.kind: r.cells for r in spark.sql("select * from pii_kinds_stream").collect()}
    want = {}
    for _, _, kind, _ in batch:
        want[kind] = want.get(kind, 0) + 1
    assert kinds == want
