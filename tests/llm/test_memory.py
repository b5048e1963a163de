"""What workers and scans hold does not stay at its highest for the stages after."""

from __future__ import annotations

from tollgate.llm import common, pii_gbt

KEY = "spark.sql.parquet.columnarReaderBatchSize"


def test_workers_return_memory_after_the_last_batch(monkeypatch):
    told = []
    monkeypatch.setattr(common, "_return_memory", lambda: told.append("returned"))

    def run(batches):
        for b in batches:
            told.append(b)
            yield -b

    assert list(common.released(run)(iter([1, 2, 3]))) == [-1, -2, -3]
    assert told == [1, 2, 3, "returned"]


def test_scans_of_texts_take_few_rows_at_a_time(spark, tmp_path):
    texts = [f"mail a{i}@example.org now" for i in range(1500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    before = spark.conf.get(KEY)
    try:
        for start, want in (("4096", 512), ("100", 100)):  # lowered, never raised
            spark.conf.set(KEY, start)
            got = pii_gbt.redact(spark.read.parquet(str(tmp_path / "d")), pii_gbt.Trees(), size_col=None).collect()
            assert int(spark.conf.get(KEY)) == want
            assert sorted(r.doc_id for r in got) == list(range(1500)) and {r.text for r in got} == {"mail [EMAIL] now"}
    finally:
        spark.conf.set(KEY, before)
