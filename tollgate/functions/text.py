"""Text normalisation as column expressions.

The normalised form of a cell is: Unicode NFKC, trim, whitespace runs to
one space, lower case -- in that order.  Whitespace means the 25 characters
of the ECMAScript ``\\s`` class, not Java's ASCII ``\\s``.

NFKC is the one step Spark has no built-in for.  It runs in the JVM through
ICU4J, which Spark 4 bundles, called with ``reflect``; only when ICU4J is
missing does an Arrow-batched pandas UDF take over, fed just the cells that
a JVM regex (built below from ``unicodedata``) flags as possibly changing.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES: the ECMAScript whitespace set (\s and String.prototype.trim),
# as code points: TAB LF VT FF CR SPACE NBSP OGHAM-SPACE-MARK U+2000..U+200A
# LINE-SEPARATOR PARAGRAPH-SEPARATOR NNBSP MMSP IDEOGRAPHIC-SPACE BOM.
WS_CODEPOINTS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680,
                 *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
WS_CLASS = "[" + "".join(f"\\x{{{c:X}}}" for c in WS_CODEPOINTS) + "]"
#: every whitespace character except the space itself
WS_OTHER = "".join(chr(c) for c in WS_CODEPOINTS if c != 0x20)
WS_RUN = WS_CLASS + "+"

#: ASCII word-boundary (the ECMAScript \b), usable in Java regexes.
ASCII_BOUNDARY = (r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"
                  r"|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


# ---------------------------------------------------------------------------
# NFKC
# ---------------------------------------------------------------------------

def _composition_seconds() -> set[int]:
    """Code points that can be the non-initial part of a canonical pair."""
    seconds = set()
    for cp in range(sys.maxunicode + 1):
        decomposition = unicodedata.decomposition(chr(cp))
        if not decomposition or decomposition.startswith("<"):
            continue
        parts = decomposition.split()
        for part in parts[1:]:
            seconds.add(int(part, 16))
    # conjoining Hangul vowels and trailing consonants compose with a lead
    seconds.update(range(0x1161, 0x1176))
    seconds.update(range(0x11A8, 0x11C3))
    return seconds


@lru_cache(maxsize=1)
def nfkc_stable_ranges(limit: int = 0x3000) -> tuple[tuple[int, int], ...]:
    """Ranges of code points below ``limit`` that NFKC leaves alone in any
    context: unchanged on their own, combining class 0, never the second
    half of a canonical composition.  A string made only of these is
    already in NFKC."""
    seconds = _composition_seconds()
    stable = []
    for cp in range(limit):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF:
            continue
        if unicodedata.combining(ch) or cp in seconds:
            continue
        if unicodedata.normalize("NFKC", ch) != ch:
            continue
        stable.append(cp)
    ranges: list[list[int]] = []
    for cp in stable:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return tuple((a, b) for a, b in ranges)


@lru_cache(maxsize=1)
def nfkc_trigger_regex() -> str:
    """Java regex that finds a character NFKC might change."""
    parts = []
    for a, b in nfkc_stable_ranges():
        parts.append(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}")
    # CJK ideographs and Hangul syllables are stable as well
    parts.append("\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7A3}")
    return "[^" + "".join(parts) + "]"


@F.pandas_udf(T.StringType())
def _nfkc_udf(values: pd.Series) -> pd.Series:
    normalize = unicodedata.normalize
    return pd.Series([None if v is None else normalize("NFKC", v) for v in values],
                     dtype=object)


_ICU = {}


def icu_available() -> bool:
    """Whether the JVM has ICU4J (bundled with Spark 4 for collations);
    checked once on the driver, without a job."""
    if "ok" not in _ICU:
        try:
            from pyspark import SparkContext

            jvm = SparkContext._active_spark_context._jvm
            jvm.java.lang.Class.forName("com.ibm.icu.text.Normalizer")
            _ICU["ok"] = True
        except Exception:
            _ICU["ok"] = False
    return _ICU["ok"]


def nfkc(col: Column) -> Column:
    """NFKC of a string column.

    JVM-side through ICU4J's static ``Normalizer.compose(text, compat=true)``
    (a quick check makes already-normal text cheap).  Without ICU4J, an
    Arrow-batched pandas UDF, fed only the cells a JVM regex flags as
    possibly changing."""
    if icu_available():
        return F.when(col.isNotNull(), F.call_function(
            "reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(True)))
    return F.coalesce(
        _nfkc_udf(F.when(col.rlike(nfkc_trigger_regex()), col)), col)


# ---------------------------------------------------------------------------
# Scalars to text
# ---------------------------------------------------------------------------

def js_double_text(col: Column) -> Column:
    """A double as ECMAScript ``String(number)`` lays it out.

    Integral values below 1e21 print without a fraction; plain notation is
    used from 1e-6 up to 1e21, exponent notation (``1e-7``, ``1e+21``)
    outside; ``-0`` prints as ``0``.
    """
    java = col.cast("string")
    a = F.abs(col)
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(java, r"E(-?[0-9]+)$", 1)
    exp_text = F.concat(
        mantissa, F.lit("e"),
        F.when(exponent.startswith("-"), exponent).otherwise(F.concat(F.lit("+"), exponent)))

    def strip_zeros(s: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")

    small_plain = strip_zeros(java.cast("decimal(38,24)").cast("string"))
    large_plain = strip_zeros(java.cast("decimal(38,17)").cast("string"))
    return (
        F.when(col.isNull(), F.lit(None))
        .when(F.isnan(col), F.lit("NaN"))
        .when(a == float("inf"), F.when(col > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
        .when((col == F.floor(col)) & (a < 1e21), col.cast("decimal(38,0)").cast("string"))
        .when((a >= 1e21) | (a < 1e-6), F.when(java.contains("E"), exp_text).otherwise(java))
        .when(a < 1e-3, small_plain)
        .when(a >= 1e7, large_plain)
        .otherwise(java)
    )


def scalar_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a non-string scalar as the gate sees it (before lower case)."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return js_double_text(col.cast("double"))
    if isinstance(dtype, T.DecimalType):
        s = col.cast("string")
        return F.when(s.contains("."), F.regexp_replace(
            F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(col)
    if isinstance(dtype, T.BinaryType):
        return F.base64(col)
    return col.cast("string")


def normalized(col: Column, dtype: T.DataType, nfkc_col: Column | None = None) -> Column:
    """The normalised scalar: never NULL, NULL becomes the text ``null``."""
    if isinstance(dtype, T.StringType):
        base = nfkc_col if nfkc_col is not None else nfkc(col)
        text = F.lower(F.trim(collapse_ws(base)))
    else:
        text = F.lower(scalar_text(col, dtype))
    return F.coalesce(text, F.lit("null"))


def collapse_ws(col: Column) -> Column:
    """Whitespace runs to one space: map every other whitespace character to
    a space (a per-character table lookup), then squeeze runs of spaces."""
    return F.regexp_replace(F.translate(col, WS_OTHER, " " * len(WS_OTHER)), " {2,}", " ")


def js_trim(col: Column) -> Column:
    """String.prototype.trim: strip the ECMAScript whitespace set."""
    return F.trim(col, F.lit(" " + WS_OTHER))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 code units (the unit the intake limits count)."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("bigint")


def placeholder_like(col: Column) -> Column:
    """True when a metadata statement is blank or a placeholder word."""
    from ..config import PLACEHOLDER_PATTERN

    t = js_trim(F.coalesce(col, F.lit("")))
    return (t == "") | t.rlike("(?i)" + PLACEHOLDER_PATTERN)
