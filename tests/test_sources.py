"""Intake: every rule through the reader that applies it."""

from __future__ import annotations

import pytest

from conftest import frame, ordered
from tollgate import Limits
from tollgate.operators.rows import ORDER_COLUMN
from tollgate.sources import readers, validate
from tollgate.sources.validate import IntakeError


@pytest.fixture
def write(tmp_path):
    def to(name, content):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
        return str(p)
    return to


def cells(df):
    return [tuple(r)[:-1] for r in df.orderBy(ORDER_COLUMN).collect()]


def test_csv_cells(spark, write):
    df = readers.read_dataset(spark, write("a.csv", b'\xef\xbb\xbf no ,boat\r\n7,"oars, two"\r\n8,"the ""Gull"""\r\n \t,\xc2\xa0\r\n9\r\n'))
    assert df.columns == ["no", "boat", ORDER_COLUMN]
    assert cells(df) == [("7", "oars, two"), ("8", 'the "Gull"'), ("9", "")]


def test_csv_line_breaks_inside_cells(spark, write):
    path = write("b.csv", 'no,boat\n1,"two\nlines"\n2,x\n')
    assert cells(readers.read_dataset(spark, path)) == [("1", "two\nlines"), ("2", "x")]


def test_csv_cell_of_a_megabyte(spark, write):
    for rest in ("", ",z"):
        path = write("c.csv", 'no,boat,sail\n1,"' + 'ab""' * 250_000 + '"' + rest + "\n2,y,z\n")
        df = readers.read_csv(spark, path, Limits(cell_characters=None))
        assert df.count() == 2 and len(df.orderBy(ORDER_COLUMN).first().boat) == 750_000


@pytest.mark.parametrize("text,says", [
    ("no,,sail\n1,2,3\n", "Column 2 has no name"), ("Boat,boat\n1,2\n", "unique"), ("prototype\n1\n", "not allowed"),
    ("no,boat\n", "no data rows"), ("no,boat\n1,x\n2,y,z\n", "Row 3 has more"), ('no,boat\n1,a"b"\n', "Row 2 has a quote"),
    ('no,boat\n1,"open\n', "quote"), ("no,boat\n1,x\n , \n2,y,\n", "Row 3 has more"), ('no,boat\n1,"x\ny",z\n', "more values"),
    ("", "no header"), ("no\n" + "k" * 5000 + "\n", "4096 characters")])
def test_csv_refusals(spark, write, text, says):
    with pytest.raises(IntakeError, match=says):
        readers.read_dataset(spark, write("d.csv", text))


def test_json_columns_follow_the_first_record(spark, write):
    text = '{"zinc":1,"alum":"a","Boat":null}\n\n{"BOAT":true," alum ":"b","zinc":2.5}\n'
    df = readers.read_dataset(spark, write("a.jsonl", text))
    assert df.columns == ["zinc", "alum", "Boat", ORDER_COLUMN]
    assert cells(df) == [(1.0, "a", None), (2.5, "b", True)]
    rows = "[" + ",".join(x for x in text.splitlines() if x) + "]"
    for name, body in (("b.json", rows), ("c.json", '{"rows":' + rows + "}")):
        assert cells(readers.read_dataset(spark, write(name, body))) == cells(df)


@pytest.mark.parametrize("text,says", [
    ('{"a":1}\n{"b":1}\n', "Row 2 .*schema"), ('{"a":1}\n{"a":[2]}\n', "Row 2 .*scalar"), ('{"a":1}\n3\n', "Row 2 .*object"),
    ('{"a":1,"A":2}\n', "unique"), ("\n", "no data rows"), ('{"a":1e999}\n{"a":0.5}\n', "finite|record rules|Row 1"),
    ('{"a":"' + "k" * 5000 + '"}\n', "4096 characters")])
def test_json_refusals(spark, write, text, says):
    with pytest.raises(IntakeError, match=says):
        readers.read_dataset(spark, write("d.jsonl", text))


def test_json_reading_does_not_sort_raw_lines(spark, write):
    plan = readers.json_lines_records(spark, write("e.jsonl", '{"a":1}\n'))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_parquet_names_and_nesting(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "` no ` int, boat string").write.parquet(str(tmp_path / "a.parquet"))
    assert readers.read_dataset(spark, str(tmp_path / "a.parquet")).columns == ["no", "boat", ORDER_COLUMN]
    spark.createDataFrame([([1],)], "v array<int>").write.parquet(str(tmp_path / "b.parquet"))
    with pytest.raises(IntakeError):
        readers.read_dataset(spark, str(tmp_path / "b.parquet"))
    with pytest.raises(IntakeError):
        readers.read_dataset(spark, "ledger.xlsx")


def test_rows_keep_their_order_over_files(spark, write, tmp_path):
    from tollgate.operators.hashing import dataset_fingerprint
    from tollgate.operators.prepare import prepare

    write("many/b.csv", "no\n" + "".join(f"b{i}\n" for i in range(2000)))
    write("many/a.csv", "no\na0\na1\n")
    seen = set()
    for size in ("64b", "4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        p = prepare(readers.read_csv(spark, str(tmp_path / "many")))
        seen.add((dataset_fingerprint(p.df).first().dataset_hash, p.columns[0], len(p.columns)))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(seen) == 1 and seen.pop()[1:] == ("no", 1)


def test_violation_frames(spark):
    df = spark.createDataFrame([("k" * 4097, [1.0], float("nan")), ("\U0001f600" * 2049, None, 1.0)],
                               "t string, e array<double>, v double")
    assert {(r.column, r.violations) for r in validate.cell_limit_violations(df).collect()} == {("t", 2)}
    assert {(r.column, r.rule, r.violations) for r in validate.scalar_violations(df).collect()} == {
        ("e", "non-scalar", 1), ("v", "non-finite", 1)}
    maps = spark.createDataFrame([(1, {"no": "1", "boat": "a"}), (2, {"NO": "1", "\u00a0boat": "a"}), (3, {"no": "1"}), (4, {})],
                                 "row bigint, cells map<string,string>")
    assert {(r.row, r.rule) for r in validate.row_shape_violations(maps).collect()} == {(3, "schema-mismatch"), (4, "no-columns")}


def test_metadata_limit(spark):
    from fixtures import FERRY
    from tollgate import Release
    from tollgate.operators.governance import releases_frame

    validate.check_metadata(releases_frame(spark, [FERRY]))
    with pytest.raises(IntakeError, match="Release big: purpose"):
        validate.check_metadata(releases_frame(spark, [FERRY, Release(release_id="big", purpose="p" * 501)]))


def test_report_and_card_sinks(spark, tmp_path):
    from fixtures import FERRY, FERRY_ROWS
    from tollgate import audit
    from tollgate.sources import sinks

    df = frame(spark, FERRY_ROWS)
    res = audit(df, FERRY, order_by=ordered(df))
    sinks.write_report(res, str(tmp_path / "report"))
    told = spark.read.json(str(tmp_path / "report" / "releases")).first()
    assert told.license == "CC0-1.0" and len(told.report_hash) == 64 and told.limitations
    sinks.write_cards(res.card(), str(tmp_path / "cards"))
    assert [p.name for p in (tmp_path / "cards").glob("release_id=*")] == ["release_id=ferries"]
