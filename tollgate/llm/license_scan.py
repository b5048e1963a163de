"""Licence scan: Aho-Corasick notices and tags, shunting-yard expressions.

One automaton holds all notice phrases, word by word and bounded by spaces, and
runs over the text's words joined by one space; so every place of every phrase
is found in one pass, overlapping ones too.  Where the words of an identifier tag
occur, the licence expression after each tag is read from the raw text: a
shunting-yard pass turns ``and`` / ``or`` / ``with`` and brackets into postfix
order, and a stack evaluates it.

Licences have a grade between 0 (nothing allowed) and 1 (attribution at
most).  ``or`` lets the reader choose (the higher grade), ``and`` binds both (the
lower), ``with`` an exception softens its licence by ``EXCEPTION``.  A document's
``score`` is the lowest grade of all its notices and expressions, 0 without any.

A task maps its texts on its own: no shuffle, whatever the skew.

Defined results: a null text counts as empty; no words give 0 words and null
places; labels are distinct, sorted and comma-joined (empty if none); an
expression is read as far as it is well formed, an open bracket closes at its
end, and a tag without a licence after it counts for nothing; repeated rows
are scanned each; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import FOLD, PLAIN, map_arrow

#: Phrases and labels to report as base.  Fixed values.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: The method's further notices.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

#: The words of an identifier tag, and the tag itself.
TAG_WORDS, TAG = "spdx license identifier", re.compile(rb"spdx-license-identifier[\x20\t]*:")

GRADES = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "zlib": 1.0,
    "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.6, "mpl-2": 0.6, "lgpl": 0.5,
    "lgpl-2.1": 0.5, "lgpl-3": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "gpl-2": 0.3, "gpl-3": 0.3, "agpl": 0.2, "agpl-3": 0.2,
    "cc-by-nd": 0.2, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "all-rights-reserved": 0.0,
}
UNKNOWN, EXCEPTION = 0.1, 0.2

RANK = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(rb"[\x20\t]*([()]|[a-z0-9.+-]*[a-z0-9+])")


def canonical(identifier: str) -> str:
    """The label of a licence identifier: its version without trailing zeros
    and without the marks of a choice of later versions."""
    name = identifier.removesuffix("+").removesuffix("-only").removesuffix("-or-later").rstrip("+")
    name = re.sub(r"^(cc-by(?:-[a-z]+)*|cc0)-[0-9.]+$", r"\1", name)
    return re.sub(r"(?<=[0-9])(?:\.0)+$", "", name)


def postfix(raw: bytes, at: int) -> list[str]:
    """The expression that starts at ``at``, in postfix order (shunting yard)."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # what comes next
    while m := TOKEN.match(raw, at):
        t = m[1].decode()
        if t == "(" and operand:
            held.append(t)
        elif t == ")" and not operand and "(" in held:
            while (op := held.pop()) != "(":
                out.append(op)
        elif t in RANK and not operand:
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[t]:
                out.append(held.pop())
            held.append(t)
            operand = True
        elif operand and t not in RANK and t not in "()":
            out.append(t)
            operand = False
        else:
            break
        at = m.end()
    if operand and held and held[-1] != "(":
        held.pop()  # an operator that still waits for its right side
    return out + [op for op in reversed(held) if op != "("]


def evaluate(tokens: list[str]) -> tuple[float, set[str]] | None:
    """(grade, labels) of a postfix expression."""
    stack: list[tuple[float, set[str]]] = []
    for t in tokens:
        if t in RANK:
            if len(stack) < 2:
                continue
            (b, lb), (a, la) = stack.pop(), stack.pop()
            if t == "with":
                stack.append((min(1.0, a + EXCEPTION), la))
            else:
                stack.append((max(a, b) if t == "or" else min(a, b), la | lb))
        else:
            label = canonical(t)
            stack.append((GRADES.get(label, UNKNOWN), {label}))
    if not stack:
        return None
    return min(g for g, _ in stack), set().union(*(s for _, s in stack))


class Scanner:
    def __init__(self, base=None, notices=None):
        import ahocorasick

        self.base = BASE if base is None else base
        self.found = ahocorasick.Automaton()
        phrases = {p: (p, label, p in self.base) for p, label in {**(NOTICES if notices is None else notices), **self.base}.items()}
        phrases[TAG_WORDS] = (TAG_WORDS, None, False)
        for phrase, value in phrases.items():
            # bytes as characters: offsets are bytes and decoding is a copy
            self.found.add_word(f" {phrase} ".encode().decode("latin-1"), value)
        self.found.make_automaton()

    def scan(self, text: str | None) -> tuple:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        words = raw.translate(PLAIN).split()
        joined = f" {b' '.join(words).decode('latin-1')} "
        n_base, first, last, base, labels, grades, tagged = 0, None, None, set(), set(), [], False
        seen = word = 0  # words that start before `seen`
        for end, (phrase, label, is_base) in self.found.iter(joined):
            if label is None:
                tagged = True
                continue
            labels.add(label)
            grades.append(GRADES.get(label, UNKNOWN))
            if is_base:
                # spaces up to this match's end, less the phrase's own words
                word += joined.count(" ", seen, end)
                seen = end
                start = word - len(phrase.split(" "))
                n_base += 1
                first = start if first is None else min(first, start)
                last = start if last is None else max(last, start)
                base.add(label)
        if tagged:
            folded = raw.translate(FOLD)
            for tag in TAG.finditer(folded):
                if got := evaluate(postfix(folded, tag.end())):
                    grades.append(got[0])
                    labels |= got[1]
        return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)),
                float(min(grades)) if grades else 0.0)


FIELDS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=None, notices=None) -> DataFrame:
    """One row per document: words, base places, labels and score."""
    import pyarrow as pa

    def make():
        scanner = Scanner(base, notices)

        def work(batch):
            rows = [scanner.scan(t.as_py()) for t in batch.column(text_col)]
            cols = list(zip(*rows, strict=True))
            out = {id_col: batch.column(id_col)}
            for k, name in enumerate(("n_words", "n_base", "first_word", "last_word")):
                out[name] = pa.array(cols[k], pa.int64())
            out |= {"base_labels": pa.array(cols[4], pa.string()), "labels": pa.array(cols[5], pa.string()),
                    "score": pa.array(cols[6], pa.float64())}
            return out

        return work

    return map_arrow(docs.select(id_col, text_col), make, FIELDS, [id_col])
