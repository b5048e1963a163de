"""Sort tasks grow in number with the bytes of the pass."""

from __future__ import annotations

from tollgate.config import Roles
from tollgate.operators import prepare


def test_sort_tasks_follow_the_bytes(spark, monkeypatch):
    from conftest import frame

    asked = []
    plain = prepare.with_row_number
    monkeypatch.setattr(prepare, "with_row_number", lambda df, *a, **k: asked.append((prepare.scan_bytes(df), k["partitions"])) or plain(df, *a, **k))
    monkeypatch.setattr(prepare, "SORT_BYTES", 1000)
    df = frame(spark, [{"id": str(i), "text": f"word {i}"} for i in range(200)])
    p = prepare.prepare(df, release_id="r", roles=Roles(id="id"), order_by=[df["__seq"]], cells=False)
    assert [n for _, n in asked] == [size // 1000 for size, _ in asked] and asked[0][1] > 8
    assert sorted(r._row for r in p.df.select("_row").collect()) == list(range(200))
