"""Files cut into splits at any byte give the rows of the file read as a whole."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tollgate.config import Limits
from tollgate.operators.rows import ORDER_COLUMN
from tollgate.sources import readers
from tollgate.sources.validate import IntakeError

CSV = ('id,text\r\n1,plain\r\n2,"two\r\nlines, ""quoted"""\n\n3,"\n\n\n"\n"4","a ""b"" c"\n5,"é\n漢字"\n6,\n'
       '7,"' + "long, long\n" * 9 + '"\n8,"""\n"""')


class Cut:
    """Splits of so many bytes while the block runs."""

    def __init__(self, spark, size):
        self.conf, self.size, self.before = spark.conf, size, {}

    def __enter__(self):
        for k, v in (("spark.sql.files.maxPartitionBytes", f"{self.size}b"), ("spark.sql.files.openCostInBytes", "1")):
            self.before[k] = self.conf.get(k)
            self.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.conf.set(k, v)


def rows_of(df):
    return [tuple(r) for r in df.orderBy(ORDER_COLUMN).drop(ORDER_COLUMN).collect()]


def write(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode())
    return str(path)


@pytest.mark.parametrize("size", [1, 2, 5, 11, 23, 64, 1000])
def test_csv_cut_anywhere(spark, tmp_path, size):
    path = write(tmp_path, "a.csv", CSV)
    want = [tuple(r) for r in csv.reader(io.StringIO(CSV, newline="")) if any(c.strip() for c in r)][1:]
    with Cut(spark, size):
        got = readers.read_csv(spark, path)
        assert rows_of(got) == want
        if size < 20:
            assert readers.pieces(spark, path, "\n").rdd.getNumPartitions() > 4


def test_csv_files_of_a_folder(spark, tmp_path):
    rnd = random.Random(4)
    want = []
    for k in range(5):
        rows = [["".join(rnd.choices('ab, "\né', k=rnd.randrange(6))) + "x", str(n)] for n in range(rnd.randrange(1, 20))]
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=rnd.choice(["\n", "\r\n"])).writerows([["t", "n"], *rows])
        write(tmp_path, f"{k}.csv", out.getvalue())
        want += [tuple(r) for r in rows]
    with Cut(spark, 9):
        assert rows_of(readers.read_csv(spark, str(tmp_path))) == want


@pytest.mark.parametrize("text, says", [
    ('a,b\n1,"x\ny",3\n', "Row 2 has more values"), ('a,b\n1,2\n3,"x\n', "Row 3 has a quote"),
    ('a,b\n1,"x\ny"z\n', "Row 2 has a quote"), ('a,b\n1,x"y\n"2",3\n4,"5"\n', "has a quote")])
def test_csv_refusals(spark, tmp_path, text, says):
    path = write(tmp_path, "a.csv", text)
    for size in (2,):
        with Cut(spark, size), pytest.raises(IntakeError, match=says):
            readers.read_csv(spark, path)


RECORDS = [{"a": 1, "b": "x"}, {"a": 2, "b": 'br}ace [ " \\ \n é'}, {"a": None, "b": ""}, {"a": -3, "b": "}" * 40}, {"b": "漢", "a": 5}]


def spelt(text):
    return [(r["a"], r["b"]) for r in json.loads(text)]


@pytest.mark.parametrize("size", [1, 3, 8, 21, 1000])
def test_json_arrays_cut_anywhere(spark, tmp_path, size):
    for k, text in enumerate((json.dumps(RECORDS, ensure_ascii=False), json.dumps(RECORDS, indent=2),
                              " [ " + " ,\n".join(json.dumps(r) for r in RECORDS) + "]\n\n")):
        path = write(tmp_path, f"{k}.json", text)
        with Cut(spark, size):
            assert rows_of(readers.read_json(spark, path)) == spelt(text), text


def test_json_files_of_a_folder_and_documents(spark, tmp_path):
    for k in range(3):
        write(tmp_path, f"{k}.json", json.dumps([{"k": k, "n": n} for n in range(k + 1)]))
    with Cut(spark, 10):
        assert rows_of(readers.read_json(spark, str(tmp_path))) == [(k, n) for k in range(3) for n in range(k + 1)]
    path = write(tmp_path / "..", "envelope.json", json.dumps({"meta": {"x": [{}]}, "rows": [{"z": 1, "a": 2}]}))
    got = readers.read_json(spark, path)
    assert got.columns[:2] == ["z", "a"] and rows_of(got) == [(1, 2)]


@pytest.mark.parametrize("text", ['[{"a":1}', '[{"a":1},{"b"', '[{"a":1} {"a":2}]', '[{"a":1},]', '[{"a":1}] x', '[{"a":}]', '{"a":1}',
                                  "[1]", '[{"a":1},2]', "", "[]", '[{"a":1},[{"a":2}]]', '[{"a":"x}]', '[{"a":[1]}]', '[{"a":1},{"b":2}]'])
def test_json_refusals(spark, tmp_path, text):
    path = write(tmp_path, "a.json", text)
    for size in (3,):
        with Cut(spark, size), pytest.raises(IntakeError):
            readers.read_json(spark, path, Limits())


def test_a_cell_longer_than_many_splits(spark, tmp_path):
    cell = "line, of a cell\n" * 20_000
    path = write(tmp_path, "a.csv", f'id,t\n1,"{cell}"\n2,x\n')
    with Cut(spark, 20_000):
        found = readers.read_csv(spark, path, Limits(cell_characters=None))
        assert found.select("id", F.length("t")).orderBy("id").collect() == [("1", len(cell)), ("2", 1)]
