"""Token sets for near-duplicate detection.

A row's tokens are the runs of letters and digits (``[\\p{L}\\p{N}]+``) in
its string feature cells, NFKC and lower-cased, taken in column order and
cut after the first ``limit`` matches (matches, not distinct tokens).  The
cut is exact: the JVM regex stops scanning a cell once it has seen
``limit`` tokens, and the rest of the cell cannot change the set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import JACCARD_DEN, JACCARD_NUM

TOKEN_RE = r"[\p{L}\p{N}]+"


def _head_re(limit: int) -> str:
    # the shortest prefix that holds the first `limit` tokens
    return r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){1," + str(limit) + "}"


def cell_tokens(nfkc_text: Column, limit: int | None) -> Column:
    """First ``limit`` token matches of one NFKC string cell (lower case)."""
    if limit is None:
        return F.regexp_extract_all(F.lower(nfkc_text), F.lit(TOKEN_RE), 0)
    head = F.regexp_extract(nfkc_text, _head_re(limit), 0)
    toks = F.regexp_extract_all(F.lower(head), F.lit(TOKEN_RE), 0)
    return F.slice(toks, 1, limit)


def row_tokens(cells: list[Column], limit: int | None) -> tuple[Column, Column]:
    """(distinct token array, at-limit flag) over the cells in order."""
    if not cells:
        empty = F.array().cast("array<string>")
        return empty, F.lit(False)
    parts = [F.coalesce(c, F.array().cast("array<string>")) for c in cells]
    allt = parts[0] if len(parts) == 1 else F.concat(*parts)
    if limit is None:
        return F.array_distinct(allt), F.lit(False)
    cut = F.slice(allt, 1, limit) if len(parts) > 1 else allt
    return F.array_distinct(cut), F.size(allt) >= limit


def prefix_length(k: Column) -> Column:
    """Prefix size for a Jaccard >= t self-join on a set of size k:
    k - ceil(t*k) + 1, in integers (t = 82/100)."""
    need = F.floor((k * JACCARD_NUM + (JACCARD_DEN - 1)) / JACCARD_DEN)
    return (k - need + 1).cast("int")


def jaccard_ok(inter: Column, ka: Column, kb: Column) -> Column:
    """Jaccard(A, B) >= 82/100 tested in integers."""
    return (inter * JACCARD_DEN) >= (JACCARD_NUM * (ka + kb - inter))


def min_size(k: Column) -> Column:
    """Smallest partner size that can still reach the threshold."""
    return F.floor((k * JACCARD_NUM + (JACCARD_DEN - 1)) / JACCARD_DEN)


def percent_text(x: Column) -> Column:
    """``(x*100).toFixed(0)`` for shares in [0, 1]."""
    return F.round(x * 100, 0).cast("bigint").cast("string")


# ---------------------------------------------------------------------------
# Exact pair arithmetic (no double rounding, no 64-bit overflow in between)
# ---------------------------------------------------------------------------

EXACT = "decimal(38,0)"


def exact(col: Column) -> Column:
    return col.cast(EXACT)


def pairs_of(n: Column) -> Column:
    """n(n-1)/2 exactly."""
    d = exact(n)
    return ((d * (d - 1)) / 2).cast(EXACT)
