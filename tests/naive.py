"""The gate's results straight from their definitions, for small tables: every
index pair is looked at, kept if it fulfils the definition, then sorted."""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

SPACES = "\t\n\x0b\x0c\r       　﻿" + "".join(map(chr, range(0x2000, 0x200b)))


def value(v) -> str:
    """A cell as the detectors compare it."""
    if v is None:
        return "null"
    if isinstance(v, str):
        words = re.split(f"[{SPACES}]+", unicodedata.normalize("NFKC", v).lower())
        return " ".join(w for w in words if w)
    if isinstance(v, bool):
        return str(v).lower()
    return str(int(v)) if float(v).is_integer() else repr(v)


def key(row: dict, roles: dict, *without: str) -> tuple:
    out = {roles.get(w) for w in without}
    return tuple((c, value(row[c])) for c in sorted(row) if c not in out)


def tokens(row: dict, roles: dict) -> frozenset:
    out = set(roles.values())
    return frozenset(t for c, v in row.items() if c not in out and isinstance(v, str)
                     for t in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", v).lower()))


def _first(keys: list) -> dict:
    return {k: i for i, k in reversed(list(enumerate(keys)))}


def exact(rows, roles):
    """(pairs, first six) of equal rows, the identifier aside."""
    keys = [key(r, roles, "id") for r in rows]
    first = _first(keys)
    found = [(first[keys[i]], i, j) for i, j in combinations(range(len(rows)), 2) if keys[i] == keys[j]]
    return len(found), [(i + 1, j + 1) for _, i, j in sorted(found)[:6]]


def near(rows, roles):
    """(pairs, first six) of rows with other features whose token sets overlap."""
    keys = [key(r, roles, "id", "split", "label") for r in rows]
    sets = [tokens(r, roles) for r in rows]
    found = [(i + 1, j + 1) for i, j in combinations(range(len(rows)), 2)
             if keys[i] != keys[j] and min(len(sets[i]), len(sets[j])) >= 5
             and 100 * len(sets[i] & sets[j]) >= 82 * len(sets[i] | sets[j])]
    return len(found), found[:6]


def leakage(rows, roles):
    """Pairs of equal examples in different splits; and for each row the first
    row of every other split that its example was seen in before."""
    keys = [key(r, roles, "id", "split") for r in rows]
    splits = [value(r[roles["split"]]) if r[roles["split"]] is not None else "" for r in rows]
    first = _first(keys)
    given = [i for i in range(len(rows)) if splits[i]]
    pairs = sum(keys[i] == keys[j] and splits[i] != splits[j] for i, j in combinations(given, 2))
    seen = {}
    for i in given:
        seen.setdefault((keys[i], splits[i]), i)
    shown = [(first[keys[i]], i, f) for i in given for (k, s), f in seen.items() if k == keys[i] and s != splits[i] and f < i]
    return pairs, [(f + 1, i + 1) for _, i, f in sorted(shown)[:6]]


def conflicts(rows, roles):
    """Feature groups with several labels: first row and first row that disagrees."""
    keys = [key(r, roles, "id", "split", "label") for r in rows]
    labels = [value(r[roles["label"]]) for r in rows]
    first = _first(keys)
    other = {}
    for i, k in enumerate(keys):
        if labels[i] != labels[first[k]]:
            other.setdefault(k, i)
    found = sorted((first[k] + 1, i + 1) for k, i in other.items())
    return len(found), found[:6]
