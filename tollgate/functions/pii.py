"""Personal-identifier matchers as column expressions (JVM regexes).

Each matcher counts validated, non-overlapping matches in a string cell.  The kinds
are a list of ``PiiPattern``, which a caller may extend.
Numeric cells use a separate rule: a safe non-negative integer is tested
as its decimal text (phone and NRIC only; email and IPv4 never match a
number).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PII_TITLES
from .text import ASCII_BOUNDARY as B
from .text import WS_CLASS

_WS_OR_DASH = WS_CLASS[:-1] + "-]"

# FIXED VALUES: the four identifier patterns (ECMAScript originals, with \b
# as an ASCII boundary and \s as the ECMAScript whitespace set).
EMAIL_LOCAL, EMAIL_DOMAIN = "[A-Z0-9._%+-]", r"[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE_RE = r"(?:\+?60|0)" + _WS_OR_DASH + r"?1[0-46-9](?:" + _WS_OR_DASH + r"?[0-9]){7,8}" + B
NRIC_RE = B + r"[0-9]{6}-?[0-9]{2}-?[0-9]{4}" + B
IPV4_RE = B + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + B
PHONE_DIGITS_RE = r"^601[0-46-9][0-9]{7,8}$"

# The email pattern (boundary, local part, @, domain, boundary) with the same matches
# in linear time.  Whether a match ends well depends on the domain alone, so of
# all boundaries inside one run of local characters only the first can start a
# match: at the run's start (or the end of the last match, \\G), or where its first
# word characters begin or end (the Kelvin sign is a word character, but no local
# one).  The local part is possessive, as it cannot hold the @.
_WORD, _NOT_WORD = ("(?:(?" + sign + "[A-Za-z0-9_])" + EMAIL_LOCAL + ")*+" for sign in "=!")
EMAIL_RE = (r"(?iu)(?:\G|(?<!" + EMAIL_LOCAL + "))(?:" + B + "|" + _NOT_WORD + B + "|" + _WORD + B + ")"
            + EMAIL_LOCAL + "++@" + EMAIL_DOMAIN + B)

MAX_SAFE_INTEGER = 9007199254740991


def _plausible_nric(x: Column) -> Column:
    digits = F.regexp_replace(x, "-", "")
    month = F.substring(digits, 3, 2).cast("int")
    day = F.substring(digits, 5, 2).cast("int")
    return digits.rlike("^[0-9]{12}$") & month.between(1, 12) & day.between(1, 31)


def _ipv4_octets_ok(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: p.cast("int") <= 255)


@dataclass(frozen=True)
class PiiPattern:
    """A kind of identifier.  ``regex`` (Java) finds it in text cells, ``valid`` says
    of a match whether it counts, ``guard`` is a pattern without which a cell holds none, and
    ``numeric`` says of the digits of a whole number whether they are one; ``names``
    are its singular and plural in reports."""

    kind: str
    regex: str
    guard: str = ""
    valid: Callable[[Column], Column] | None = None
    numeric: Callable[[Column], Column] | None = None
    names: tuple[str, str] | None = None

    def titles(self) -> tuple[str, str]:
        return self.names or (f"{self.kind} value", f"{self.kind} values")


PATTERNS = (
    PiiPattern("email", EMAIL_RE, "@", names=PII_TITLES["email"]),
    PiiPattern("phone", PHONE_RE, "[0-9]", numeric=lambda x: x.rlike(PHONE_DIGITS_RE), names=PII_TITLES["phone"]),
    PiiPattern("nric", NRIC_RE, "[0-9]{6}", _plausible_nric, _plausible_nric, PII_TITLES["nric"]),
    PiiPattern("ip", IPV4_RE, r"[0-9]\.[0-9]{1,3}\.[0-9]", _ipv4_octets_ok, names=PII_TITLES["ip"]),
)


def _pattern(kind: str | PiiPattern) -> PiiPattern:
    return kind if isinstance(kind, PiiPattern) else next(p for p in PATTERNS if p.kind == kind)


def string_match_count(col: Column, kind: str | PiiPattern) -> Column:
    """Validated match count of one kind in a string cell (0 for NULL)."""
    pattern = _pattern(kind)
    matches = F.regexp_extract_all(col, F.lit(pattern.regex), 0)
    if pattern.valid is not None:
        matches = F.filter(matches, pattern.valid)
    has = col.rlike(pattern.guard) if pattern.guard else F.lit(True)
    return F.when(col.isNotNull() & has, F.size(matches)).otherwise(F.lit(0))


def numeric_match_count(col: Column, dtype: T.DataType, kind: str | PiiPattern) -> Column:
    """0/1 for a numeric cell: a safe non-negative integer whose decimal
    text passes the kind's rule for numbers."""
    pattern = _pattern(kind)
    if pattern.numeric is None:
        return F.lit(0)
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        v = col.cast("double")
        ok = (v == F.floor(v)) & (v >= 0) & (v <= float(MAX_SAFE_INTEGER))
        text = v.cast("decimal(20,0)").cast("string")
    else:
        ok = (col >= 0) & (col <= F.lit(MAX_SAFE_INTEGER))
        text = col.cast("string")
    return F.when(col.isNotNull() & ok & pattern.numeric(text), F.lit(1)).otherwise(F.lit(0))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                              T.FloatType, T.DoubleType, T.DecimalType))


def match_count(col: Column, dtype: T.DataType, kind: str | PiiPattern) -> Column:
    """Match count for any scalar column type."""
    if isinstance(dtype, T.StringType):
        return string_match_count(col, kind)
    if is_numeric(dtype):
        return numeric_match_count(col, dtype, kind)
    return F.lit(0)


def cell_hits(columns: list[tuple[str, T.DataType]], patterns: Sequence[PiiPattern] = PATTERNS) -> Column:
    """array<struct<col_pos, column, kind, matches>> of the cells of a row
    with at least one match, in column order then in the order of ``patterns``."""
    entries = []
    for pos, (name, dtype) in enumerate(columns):
        if not (isinstance(dtype, T.StringType) or is_numeric(dtype)):
            continue
        for pattern in patterns:
            if not isinstance(dtype, T.StringType) and pattern.numeric is None:
                continue
            entries.append(F.struct(
                F.lit(pos).alias("col_pos"),
                F.lit(name).alias("column"),
                F.lit(pattern.kind).alias("kind"),
                match_count(F.col(f"`{name}`"), dtype, pattern).cast("int").alias("matches"),
            ))
    if not entries:
        return F.array().cast(
            "array<struct<col_pos:int,column:string,kind:string,matches:int>>")
    return F.filter(F.array(*entries), lambda s: s["matches"] > 0)
