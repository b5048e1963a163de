"""Personal data by generated candidates and boosted trees [native].

High-recall patterns propose spans of every kind; spans of different kinds may
overlap.  Each candidate gets binned features of its format (length, digits,
letters, separators) and its context (the character before it, a cue word in
the 24 characters before it).  A span that passes its kind's strict rule
is always kept: the contract's rule (``base``), or for secrets a known key prefix
or an assignment to a telling name, for id numbers their form.  So what has
such a sign is found alike in a table of any size.  For the others, gradient-boosted
trees estimate from format and context the probability of being personal data; a
threshold for each kind, calibrated on documents held out from boosting, selects
what is added.  Where the held-out candidates are too few for that, or none of
their margins is precise enough, it is the margin of ``PRIOR``.

Nothing is labelled by hand: a candidate counts as positive if its kind's strict
rule holds (top-level domain, octets, Luhn sum, digit count, key prefix or
assignment).  The trees learn from the counts of every feature vector over the
whole table.  There are at most ``MAX_VECTORS`` such vectors, so that table, not
the corpus, goes to the driver; the trees come back as one SQL expression.

Everything on the data is a DataFrame or SQL expression.  Patterns are
possessive, with a look-behind where a failed start would be retried inside a
run, so that each text is read in linear time without recursion.

Defined results: a null text counts as empty and has no spans; offsets are code
points; equal rows give equal results; an empty table gives an empty result
and the trees then add nothing; other columns are carried or ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_scans

#: Kinds in the order in which spans at one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "id")
N_BASE = 4

# A match may begin at the end of the last one or where no character of the same
# run stands before: any other start inside a run fails as the run's start did.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # the first two look-behinds say the same as the third, less and cheaper
    "secret": r"(?<=[=:\x20\"'])(?<=[=:][\x20]{0,2}[\"']{0,1})(?<=(?i:passw|passwd|password|pwd|pass|token|secret|api[_-]?key)[\x20]{0,2}[=:][\x20]{0,2}[\"']{0,1})"
              r"(?=[^\s\"'<>0-9]*+[0-9])[^\s\"'<>]{6,}+"
              r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a kind's pattern to be tried at all.
GUARDS = {"email": "@", "phone": "+"}

CUES = {
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|master|pay",
    "phone": "phone|tel|call|fax|mobile", "secret": "pass|token|secret|key|pwd|auth",
    "id": "ssn|social|id",
}
#: The probability from which trees add a span that calibration cannot judge.
PRIOR = 0.95
#: The name and sign before an assigned secret, and the forms of well-known keys.
ASSIGNED = r"(?i)(passw|passwd|password|pwd|pass|token|secret|api[_-]?key)[\x20]{0,2}[=:][\x20]{0,2}[\"']?$"
KEYS = "^(AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{30,}|sk-[0-9A-Za-z]{20,})$"
FEATURES = ("kind", "length", "digits", "letters", "seps", "before", "cue")
BINS = (6, 8, 6, 4, 4, 4, 2)
MAX_VECTORS = math.prod(BINS)


def _matches(text: Column, kind: str) -> Column:
    """array<struct<start,value,before>> of a kind's matches; the fold adds up
    the lengths of the gaps between them, in chunks so that long lists stay
    linear."""
    pattern = F.lit(PATTERNS[kind])
    gaps = F.split(text, PATTERNS[kind], -1)
    pairs = F.zip_with(gaps, F.regexp_extract_all(text, pattern, F.lit(0)),
                       lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    one = "struct<start:bigint,value:string,before:string>"
    zero = F.expr(f"named_struct('pos', 0L, 'cur', cast(array() as array<{one}>), "
                  f"'done', cast(array() as array<array<{one}>>))")

    def step(a: Column, x: Column) -> Column:
        start = a["pos"] + F.length(x["g"])
        new = F.struct(start.cast("long").alias("start"), x["m"].alias("value"),
                       F.right(x["g"], F.lit(24)).alias("before"))
        full = F.size(a["cur"]) >= 256
        return F.when(x["m"].isNull(), a).otherwise(F.struct(
            (start + F.length(x["m"])).cast("long").alias("pos"),
            F.when(full, F.array(new)).otherwise(F.concat(a["cur"], F.array(new))).alias("cur"),
            F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done")))

    found = F.aggregate(pairs, zero, step, lambda a: F.concat(F.flatten(a["done"]), a["cur"]))
    guard = F.instr(text, GUARDS[kind]) > 0 if kind in GUARDS else F.lit(True)
    return F.when(guard, found).otherwise(F.expr(f"cast(array() as array<{one}>)"))


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    rev = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(rev, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") >= 5, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def _strict(kind: str, value: Column, before: Column) -> tuple[Column, Column]:
    """(passes the strict rule of its kind, counts as positive for the trees)."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True), value.rlike(r"\.[A-Za-z]{2,24}$")
    if kind == "ip":
        ok = F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                      & (F.coalesce(F.right(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
        return ok, ok
    if kind == "card":
        ok = F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits))
        return F.coalesce(ok, F.lit(False)), F.coalesce(ok, F.lit(False))
    if kind == "phone":
        ok = F.length(digits).between(9, 15)
        return ok, ok
    if kind == "secret":
        return F.lit(False), before.rlike(ASSIGNED) | value.rlike(KEYS)
    return F.lit(False), ~value.rlike("^(000|666|9)|-00-|-0000$")


def _bin(c: Column, cuts: tuple[int, ...]) -> Column:
    out = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        out = F.when(c < cuts[k], k).otherwise(out)
    return out


def _described(kind: str, m: Column) -> Column:
    """A match with its end, strict rule, label and feature vector."""
    value, before = m["value"], m["before"]
    length = F.length(value)
    digits = length - F.length(F.regexp_replace(value, "[0-9]", ""))
    letters = length - F.length(F.regexp_replace(value, "[A-Za-z]", ""))
    last = F.right(before, F.lit(1))
    base, positive = _strict(kind, value, before)
    share = F.when(letters == 0, 0).when(letters * 3 < length, 1).when(letters * 3 < length * 2, 2).otherwise(3)
    side = F.when((last == "") | last.rlike(r"\s"), 0).when(last.rlike("[A-Za-z]"), 1).when(last.rlike("[0-9]"), 2).otherwise(3)
    vector = F.array(
        F.lit(KINDS.index(kind)), _bin(length, (8, 12, 15, 17, 20, 28, 41)), _bin(digits, (1, 4, 8, 12, 17)),
        share, _bin(length - digits - letters, (1, 3, 6)), side,
        F.lower(before).rlike(f"({CUES[kind]})[^\\n]{{0,12}}$").cast("int")).cast("array<int>")
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                    (m["start"] + length).cast("long").alias("end"), base.alias("base"),
                    positive.alias("positive"), vector.alias("x"))


def candidates(text: Column) -> Column:
    """array<struct<start,kind,end,base,positive,x>>: every proposed span."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(*[F.transform(_matches(text, k), partial(_described, k)) for k in KINDS])
    return F.when(text.rlike("[0-9@]"), found)


# ---------------------------------------------------------------------------
# Boosted trees over the table of feature vectors
# ---------------------------------------------------------------------------


@dataclass
class Trees:
    """Depth-2 trees as (f1, c1, f2, c2, f3, c3, four leaves): x[f1] < c1 goes to
    the split (f2, c2), the rest to (f3, c3)."""

    bias: float = -20.0
    trees: list[tuple] = field(default_factory=list)
    threshold: dict[int, float] = field(default_factory=dict)

    def margin(self, x) -> float:
        m = self.bias
        for f1, c1, f2, c2, f3, c3, leaves in self.trees:
            m += leaves[(0 if x[f2] < c2 else 1) if x[f1] < c1 else (2 if x[f3] < c3 else 3)]
        return m

    def margin_column(self, x: Column) -> Column:
        m = F.lit(float(self.bias))
        for f1, c1, f2, c2, f3, c3, v in self.trees:
            m = m + F.when(x[f1] < c1, F.when(x[f2] < c2, v[0]).otherwise(v[1])) \
                .otherwise(F.when(x[f3] < c3, v[2]).otherwise(v[3]))
        return m


def _best_split(rows: list, lam: float):
    """The cut (feature, value) with the largest gain over rows (x, g, h)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, gain = (0, 0), 0.0
    for f, bins in enumerate(BINS):
        sums = [[0.0, 0.0] for _ in range(bins)]
        for x, rg, rh in rows:
            sums[x[f]][0] += rg
            sums[x[f]][1] += rh
        lg = lh = 0.0
        for c in range(1, bins):
            lg, lh = lg + sums[c - 1][0], lh + sums[c - 1][1]
            new = lg * lg / (lh + lam) + (g - lg) ** 2 / (h - lh + lam) - g * g / (h + lam)
            if new > gain + 1e-9:
                best, gain = (f, c), new
    return best


def boost(counts: list, rounds: int = 24, rate: float = 0.4, lam: float = 1.0) -> Trees:
    """Logistic boosting over (x, positives, n)."""
    pos, n = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not n:
        return Trees()
    model = Trees(math.log((pos + 0.5) / (n - pos + 0.5)))
    margins = [model.bias] * len(counts)
    for _ in range(rounds):
        rows = []
        for (x, p, k), m in zip(counts, margins):
            q = 1 / (1 + math.exp(-m))
            rows.append((x, p - k * q, k * q * (1 - q)))
        f1, c1 = _best_split(rows, lam)
        left, right = [r for r in rows if r[0][f1] < c1], [r for r in rows if r[0][f1] >= c1]
        (f2, c2), (f3, c3) = _best_split(left, lam), _best_split(right, lam)
        parts = [[r for r in left if r[0][f2] < c2], [r for r in left if r[0][f2] >= c2],
                 [r for r in right if r[0][f3] < c3], [r for r in right if r[0][f3] >= c3]]
        leaves = tuple(max(-4.0, min(4.0, rate * sum(r[1] for r in p) / (sum(r[2] for r in p) + lam))) for p in parts)
        model.trees.append((f1, c1, f2, c2, f3, c3, leaves))
        single = Trees(0.0, [model.trees[-1]])
        margins = [m + single.margin(c[0]) for c, m in zip(counts, margins)]
    return model


def calibrate(model: Trees, held: list, precision: float = PRIOR, least: int = 20) -> None:
    """For each kind the lowest margin from which on at least ``precision`` of the
    held-out candidates are positive, judged by ``least`` of them or more; without
    one, the margin of that probability."""
    for kind in range(len(KINDS)):
        model.threshold[kind] = math.log(precision / (1 - precision))
        rows = sorted(((model.margin(x), p, n) for x, p, n in held if x[0] == kind), reverse=True)
        pos = n = 0
        for m, p, k in rows:
            pos, n = pos + p, n + k
            if n >= least and pos >= precision * n:
                model.threshold[kind] = m


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> Trees:
    """Boosts on the feature counts of all documents but one fold, by which the
    thresholds are calibrated."""
    held = F.pmod(F.xxhash64(F.col(id_col)), F.lit(folds)) == 0
    counts = (small_scans(docs).select(held.alias("held"), F.explode(candidates(F.col(text_col))).alias("c"))
              .groupBy("held", F.col("c.x").alias("x"))
              .agg(F.sum(F.col("c.positive").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
              .limit(2 * MAX_VECTORS).collect())
    model = boost(sorted((tuple(r.x), r.pos, r.n) for r in counts if not r.held))
    calibrate(model, [(tuple(r.x), r.pos, r.n) for r in counts if r.held])
    return model


def spans(text: Column, model: Trees) -> Column:
    """array<struct<start,kind,end,base>> in order: base spans, those that their rule
    marks, and those the trees add."""

    def keep(c: Column) -> Column:
        added = (c["kind"] >= N_BASE) & c["positive"]
        for kind, m in sorted(model.threshold.items()):
            added = added | ((c["kind"] == kind) & (model.margin_column(c["x"]) >= m - 1e-9))
        return c["base"] | added

    kept = F.filter(F.coalesce(candidates(text), F.expr(
        "cast(array() as array<struct<start:bigint,kind:int,end:bigint,base:boolean,positive:boolean,x:array<int>>>)")), keep)
    return F.array_sort(F.transform(kept, lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"))))


def listed(found: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with each maximal run of overlapping spans replaced by the
    bracketed kind of its first span.  A null text stays null."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.expr("named_struct('pos', 0L, 'cur', cast(array() as array<string>), "
                  "'done', cast(array() as array<array<string>>))")

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, (a["pos"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int")),
                         F.get(names, s["kind"]))
        full = F.size(a["cur"]) >= 256
        new = F.struct(
            s["end"].alias("pos"),
            F.when(full, F.array(piece)).otherwise(F.concat(a["cur"], F.array(piece))).alias("cur"),
            F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"))
        inside = F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), a["cur"].alias("cur"), a["done"].alias("done"))
        return F.when(s["start"] < a["pos"], inside).otherwise(new)

    out = F.aggregate(found, zero, step, lambda a: F.concat(
        F.array_join(F.concat(F.flatten(a["done"]), a["cur"]), ""),
        F.substring(text, (a["pos"] + 1).cast("int"), F.lit(2147483647))))
    return F.when(F.size(found) == 0, text).otherwise(out)


def _is_kind(kind: int, span: Column) -> Column:
    return span["kind"] == kind


def scan(docs: DataFrame, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, base digest and spans."""
    model = model or fit(docs, id_col, text_col)
    found = small_scans(docs).select(F.col(id_col), spans(F.col(text_col), model).alias("s"))
    base = F.filter("s", lambda s: s["base"])
    return found.select(
        id_col,
        *[F.size(F.filter(base, partial(_is_kind, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(N_BASE)],
        F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"),
        listed(F.col("s")).alias("spans"))


def redact(docs: DataFrame, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text",
           size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the spans in its text replaced; ``size_col``, where there is
    such a column, becomes the new text's length."""
    model = model or fit(docs, id_col, text_col)
    text = redacted(F.col(text_col), spans(F.col(text_col), model))
    size = [c for c in docs.columns if c == size_col]
    out = small_scans(docs).withColumn(text_col, text)
    return out.withColumns({c: F.length(text_col).cast(docs.schema[c].dataType) for c in size})
