"""Matchers whose time grows with the text's length, not with its square."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from tollgate.functions import pii, text

#: The pattern as it is defined, with every boundary as a start.
DEFINED = "(?iu)" + text.ASCII_BOUNDARY + r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}" + text.ASCII_BOUNDARY


def test_email_counts_on_random_text(spark):
    rnd = random.Random(7)
    pieces = ["a", "b1", "@", ".", "com", "-", "+", "%", "_", " ", "é", "K", "ſ", "x@y.zz", "a@b.com.", "-@y.org"]
    rows = ["".join(rnd.choices(pieces, k=rnd.randrange(1, 16))) for _ in range(6000)]
    rows += ["a@b.com-@y.org", "a@b.com.x@y.org", "a@b.comé@c.de", "..a@b.cd", "%%@b.cd", "a@b.c", "a@b.c1 d@e.fg_", "\u212aa@b.cd"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v string")
    got = df.select("v", pii.string_match_count(F.col("v"), "email").alias("n"),
                    F.size(F.regexp_extract_all("v", F.lit(DEFINED), F.lit(0))).alias("want")).collect()
    wrong = [r for r in got if r.n != r.want]
    assert not wrong and sum(r.n for r in got) > 500


def seconds(df) -> float:
    start = time.time()
    df.collect()
    return time.time() - start


def test_a_megabyte_in_one_cell(spark):
    count = pii.string_match_count(F.col("v"), "email").alias("n")
    seconds(spark.createDataFrame([("x@",)], "v string").select(count))
    for run in ("a.", "a", "a@", ".", "a@b.", "a@b.c-", "+a", "a@b.cd."):
        df = spark.range(1).select(F.concat(F.repeat(F.lit(run), 1_000_000 // len(run)), F.lit(" x@")).alias("v"))
        assert seconds(df.select(count)) < 5, run
    df = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" \t"), 500_000), F.lit("b")).alias("v"))
    assert seconds(df.select(F.length(text.js_trim(F.col("v"))))) < 5


def test_trim_takes_every_white_space(spark):
    blanks = "".join(map(chr, text.WS_CODEPOINTS))
    rows = [(blanks + "a" + blanks + "b" + blanks, "a" + blanks + "b"), (blanks, ""), ("", ""), ("​a᠎", "​a᠎"), (None, None)]
    df = spark.createDataFrame(rows, "v string, want string")
    assert all(r.got == r.want for r in df.select("want", text.js_trim(F.col("v")).alias("got")).collect())
