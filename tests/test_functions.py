"""Column-expression tests: normalisation, number layout, NFKC, tokens,
PII matchers, inert Markdown and neutral class tokens."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions import pii, text, tokens
from tollgate.operators.card import inert_markdown


def one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(col(F.col("v")).alias("x")).first().x


def test_normalised_scalar(spark):
    n = lambda c: text.normalized(c, T.StringType())
    assert one(spark, n, "  Hello 　 WORLD\t\n ") == "hello world"
    assert one(spark, n, "ﬁne Ａ") == "fine a"  # NFKC: ligature, full width
    assert one(spark, n, None) == "null"
    assert one(spark, n, "null") == "null"
    assert one(spark, lambda c: text.normalized(c, T.BooleanType()), True, "boolean") == "true"


def test_js_number_layout(spark):
    cases = {1.0: "1", 100000000.0: "100000000", 1e-7: "1e-7", 0.4: "0.4", -0.0: "0",
             1.5e-4: "0.00015", 12345678.9: "12345678.9", 1e21: "1e+21", 2.5e-8: "2.5e-8",
             123.456: "123.456", 1e300: "1e+300"}
    for v, want in cases.items():
        assert one(spark, text.js_double_text, v, "double") == want, v


def test_nfkc_matches_python_on_random_text(spark):
    rnd = random.Random(3)
    pool = ("abcXYZ 09 éüßçñ ΑΩαω Жж ｱｲ ㌀ ﬁ ① ½ ² Ⅻ ℌ ́̈ é "
            "ﾊﾟ 가각 가    한국 中文 😀 ẛ̣")
    values = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.x for r in df.select(text.nfkc(F.col("v")).alias("x")).collect()]
    assert got == [unicodedata.normalize("NFKC", v) for v in values]


def test_nfkc_stable_ranges_are_stable():
    rnd = random.Random(5)
    cps = [cp for a, b in text.nfkc_stable_ranges() for cp in range(a, b + 1)]
    for _ in range(2000):
        s = "".join(chr(rnd.choice(cps)) for _ in range(rnd.randint(1, 8)))
        assert unicodedata.normalize("NFKC", s) == s


def test_tokens_cut_after_limit_matches(spark):
    df = spark.createDataFrame([(" ".join(f"t{i}" for i in range(100)) + " a_b",),
                                ("Ünïcode İS Fine, x-y 42",)], "v string")
    toks = [r.t for r in df.select(tokens.cell_tokens(F.col("v"), 64).alias("t")).collect()]
    assert toks[0] == [f"t{i}" for i in range(64)]
    assert toks[1][:2] == ["ünïcode", "i"]  # dotted capital I lowers to i + combining dot
    full = [r.t for r in df.select(tokens.cell_tokens(F.col("v"), None).alias("t")).collect()]
    assert full[0][-2:] == ["a", "b"]  # underscore splits tokens


def test_pii_matchers(spark):
    cases = [
        ("mail synthetic.person@example.com now", "email", 1),
        ("a@b.c", "email", 0),
        ("x@ex.io,y@ex.io", "email", 2),
        ("+60 13-222 3344", "phone", 1),
        ("0123456789", "phone", 1),
        ("call 60 12 345 6789 today", "phone", 1),
        ("010203-04-5678", "nric", 1),
        ("011303-04-5678", "nric", 0),  # month 13
        ("900101-13-5678", "phone", 1),  # overlap kept on purpose
        ("900101-13-5678", "nric", 1),
        ("198.51.100.24", "ip", 1),
        ("999.1.1.1", "ip", 0),
        ("éabc@example.com", "email", 1),  # ASCII boundary: é is not a word char
        ("v1.2.3.4", "ip", 0),
    ]
    df = spark.createDataFrame([(v, k) for v, k, _ in cases], "v string, k string")
    out = df.select(*[pii.string_match_count(F.col("v"), k).alias(k)
                      for k in ("email", "phone", "nric", "ip")]).collect()
    for (v, k, want), row in zip(cases, out):
        assert row[k] == want, (v, k)


def test_numeric_identifier_rule(spark):
    df = spark.createDataFrame([(60123456789, 900101135678, 0.973)], "a bigint, b bigint, c double")
    r = df.select(pii.numeric_match_count(F.col("a"), T.LongType(), "phone").alias("p"),
                  pii.numeric_match_count(F.col("b"), T.LongType(), "nric").alias("n"),
                  pii.numeric_match_count(F.col("c"), T.DoubleType(), "nric").alias("c")).first()
    assert (r.p, r.n, r.c) == (1, 1, 0)


def test_inert_markdown(spark):
    assert one(spark, inert_markdown, "![x](javascript:y)") == \
        "&#33;&#91;x&#93;&#40;javascript&#58;y&#41;"
    assert one(spark, inert_markdown, "  ") == "Not supplied"
    assert one(spark, inert_markdown, "a\r\nb") == "a b"


def test_percent_half_up(spark):
    df = spark.createDataFrame([(0.825,), (0.835,), (24 / 28,)], "x double")
    assert [r.p for r in df.select(tokens.percent_text(F.col("x")).alias("p")).collect()] == \
        ["83", "84", "86"]
