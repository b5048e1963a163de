"""Benchmark decontamination by spaced seeds.

A seed is a mask over ``SPAN`` consecutive words that hashes some of them and
ignores the others, so a word substituted at an ignored place does not hide a
match.  The masks together hit every stretch of ``WINDOW`` words with at most
``ALLOWED`` substitutions (and shorter items with proportionally fewer; a test
tries all of them).  The hashes of the benchmark's seeds are joined with those of
the documents, and around each hit document and item are compared word by word
on that alignment: the document is contaminated if some window has at most the
allowed substitutions.

Words are runs of digits, letters (A-Z lower-cased) and marks, cut at ASCII signs,
Unicode punctuation and spaces, so these do not hide a copy either; invisible
format characters are left out.  A symbol, and each character of a script without
spaces (``ALONE``), is a word of its own.  Items of fewer than ``LEAST`` words could
match in pieces by chance; they are found where all their words follow each other,
with white space between the same words as in the item.

The benchmark is dealt into blocks of at most ``BLOCK_CHARS`` characters by the
hash of its ids; each block's index goes to the executors, and the documents
are scanned once for each block, in place: documents are never shuffled, and
neither a hot group nor a long text meets others in a task.

Defined results: null or empty texts are clean, items without words are ignored; equal
documents get equal rows, equal items a row each; other columns are ignored
(``find``) or carried (``keep_clean``); an empty table on either side gives no
contaminated documents.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, map_arrow, released, small_batches

#: Places that a mask hashes, counted from its first word.  Fixed masks.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 7))
SPAN = max(m[-1] for m in MASKS) + 1
WINDOW, ALLOWED, LEAST = 13, 2, 8
BLOCK_CHARS = 16_000_000
_TABLE_BITS = 22
_P = np.uint64(0x9E3779B97F4A7C15)


#: Starts and ends (exclusive) of scripts without spaces: Thai and Lao, Myanmar, Khmer, Tai, Balinese, Han with
#: kana and bopomofo, Yi, Javanese, Tai Viet, half-width kana, Han beyond the first plane.
ALONE = (0x0E00, 0x0F00, 0x1000, 0x10A0, 0x1780, 0x1800, 0x1950, 0x19E0, 0x1A20, 0x1AB0, 0x1B00, 0x1B80, 0x2E80, 0x3000,
         0x3005, 0x3008, 0x3021, 0x3030, 0x3031, 0x3130, 0x31A0, 0x31C0, 0x31F0, 0x3200, 0x3400, 0xA4D0, 0xA980, 0xAA00,
         0xAA60, 0xAAE0, 0xF900, 0xFB00, 0xFF66, 0xFFA0, 0x16FE0, 0x18D80, 0x1AFF0, 0x1B170, 0x20000, 0x40000)
#: As ``PLAIN``, but only white space is a space; other cuts are the byte 1.
_CUT = bytes(32 if b in b"\t\n\v\f\r\x1c\x1d\x1e\x1f " else 1 if PLAIN[b] == 32 else PLAIN[b] for b in range(256))
_JOINED = bytes.maketrans(b"\1", b" ")


class _Signs(dict):
    """What becomes of each character, for ``str.translate``."""

    def __missing__(self, c: int):
        kind = unicodedata.category(chr(c))
        if c < 128:
            out = chr(c)
        elif kind[0] == "Z" or kind == "Cc" or c == 0x200B:
            out = " "
        elif kind == "Cf" or 0xFE00 <= c < 0xFE10 or 0xE0100 <= c < 0xE01F0:  # with variation selectors
            out = None
        elif kind[0] == "P":
            out = "\1"
        elif kind[0] == "S" or bisect_right(ALONE, c) % 2:
            out = f"\1{chr(c)}\1"
        else:
            out = chr(c)
        self[c] = out
        return out


_SIGNS = _Signs()


def _cut_text(text: str | None) -> bytes:
    if not text:
        return b""
    return (text if text.isascii() else text.translate(_SIGNS)).encode("utf-8", "surrogatepass").translate(_CUT)


def words_in(text: str | None) -> list[bytes]:
    return _cut_text(text).translate(_JOINED).split()


def after_space(text: str | None) -> np.ndarray:
    """For each of ``words_in``, whether white space stands before it."""
    out, space = [], False
    for k, chunk in enumerate(_cut_text(text).split(b" ")):
        space |= k > 0
        if n := len(chunk.translate(_JOINED).split()):
            out += [space] + [False] * (n - 1)
            space = False
    return np.array(out, dtype=bool)


def window_of(n: int) -> tuple[int, int]:
    """(words, allowed substitutions) of the window for an item of ``n`` words."""
    return (WINDOW, ALLOWED) if n >= WINDOW else (n, ALLOWED * n // WINDOW)


def seeds(ids: np.ndarray, mask: int) -> np.ndarray:
    """The hash of mask number ``mask`` at each start in ``ids``."""
    n = len(ids) - MASKS[mask][-1]
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, mask + 1, dtype=np.uint64)
    for o in MASKS[mask]:
        h ^= ids[o:o + n]
        h *= _P
        h ^= h >> np.uint64(29)
    return h


class Index:
    """The benchmark's words, items and seeds; bounded by its block."""

    def __init__(self, items: list[tuple]):
        self.word: dict[bytes, int] = {}
        self.keys, self.items = [], []
        short: dict[int, list[tuple]] = {}
        for key, text in items:
            words = words_in(text)
            if words:
                self.keys.append(key)
                self.items.append(np.array([self.word.setdefault(w, len(self.word) + 1) for w in words], dtype=np.uint64))
            if 0 < len(words) < LEAST:
                short.setdefault(len(words), []).append((len(self.items) - 1, after_space(text)[1:]))
        #: For each number of words: hashes in order, items, words, white space between them.
        self.short = {}
        for n, found in sorted(short.items()):
            own = np.stack([self.items[k] for k, _ in found])
            h = self._rolled(own.T)
            order = np.argsort(h, kind="stable")
            self.short[n] = (h[order], np.array([k for k, _ in found])[order], own[order], np.stack([g for _, g in found])[order])
        parts = [(seeds(x, m), k) for m in range(len(MASKS)) for k, x in enumerate(self.items) if len(x) >= LEAST]
        h = np.concatenate([p for p, _ in parts] or [np.empty(0, np.uint64)])
        item = np.concatenate([np.full(len(p), k) for p, k in parts] or [np.empty(0, np.int64)])
        at = np.concatenate([np.arange(len(p)) for p, _ in parts] or [np.empty(0, np.int64)])
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order], item[order].astype(np.int64), at[order].astype(np.int64)
        self.likely = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.likely[(self.h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    @staticmethod
    def _rolled(columns) -> np.ndarray:
        """The hash of each row of words, given by their columns."""
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = (h ^ c) * _P
            h ^= h >> np.uint64(29)
        return h

    def _laid(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of all texts with gaps between texts, and where each begins and ends."""
        get = self.word.get
        blocks, starts, ends, size = [], [], [], 0
        gap = np.zeros(SPAN, dtype=np.uint64)
        for t in texts:
            words = words_in(t)
            ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
            starts.append(size)
            ends.append(size + len(ids))
            blocks += [ids, gap]
            size += len(ids) + SPAN
        ids = np.concatenate(blocks) if blocks else gap
        return ids, np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """``scan`` and the places of the short items."""
        if not self.items:
            return []
        laid = self._laid(texts)
        return sorted(self.scan(texts, laid) + self._whole(texts, *laid)) if self.short else self.scan(texts, laid)

    def _whole(self, texts, ids, first, last) -> list[tuple[int, int, int, int, int]]:
        """The first place of each short item in each text."""
        out, spaces = [], {}
        for n, (hashes, items, words, gaps) in self.short.items():
            if len(ids) < n:
                continue
            h = self._rolled([ids[o:len(ids) - n + 1 + o] for o in range(n)])
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            found = set()
            for at in np.flatnonzero(hi > lo).tolist():
                d = int(np.searchsorted(first, at, "right")) - 1
                if at + n > last[d]:  # into the gap behind
                    continue
                if d not in spaces:
                    spaces[d] = after_space(texts[d])
                place = at - int(first[d])
                between = spaces[d][place + 1:place + n]
                for k in range(int(lo[at]), int(hi[at])):
                    item = int(items[k])
                    if (d, item) not in found and (words[k] == ids[at:at + n]).all() and (gaps[k] == between).all():
                        found.add((d, item))
                        out.append((d, item, place, n, n))
        return out

    def scan(self, texts: list[str | None], laid: tuple | None = None) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, equal words) of each contaminated text
        and item of ``LEAST`` words or more, on the alignment with the most equal words."""
        if not len(self.h):
            return []
        ids, first, last = laid or self._laid(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for m in range(len(MASKS)):
            h = seeds(ids, m)
            at = np.flatnonzero(self.likely[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
            n = hi - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs = np.unique(np.stack([self.item[which], np.repeat(at, n) - self.at[which]], axis=1), axis=0) \
                if len(which) else np.empty((0, 2), np.int64)
            for item, line in pairs.tolist():
                if (item, line) not in tried:
                    tried.add((item, line))
                    self._compare(ids, first, last, item, line, best)
        return [(d, k, *v) for (d, k), v in sorted(best.items())]

    def _compare(self, ids, first, last, item: int, line: int, best: dict) -> None:
        """Compares item and text with the item's first word at ``line``."""
        words = self.items[item]
        w, allowed = window_of(len(words))
        # an alignment may reach over the gap into the next text: each on its own
        d = int(np.searchsorted(last, line, "right"))
        while d < len(first) and first[d] < line + len(words):
            a, b = max(int(first[d]), line), min(int(last[d]), line + len(words))
            if b - a >= w:
                same = np.r_[0, np.cumsum(ids[a:b] == words[a - line:b - line])]
                good = np.flatnonzero(same[w:] - same[:-w] >= w - allowed)
                if len(good):
                    lo, hi = int(good[0]), int(good[-1]) + w
                    found = (a + lo - int(first[d]), hi - lo, int(same[hi] - same[lo]))
                    old = best.get((d, item))
                    if old is None or (found[2], -found[0]) > (old[2], -old[0]):
                        best[d, item] = found
            d += 1


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text"):
    """The benchmark's index in blocks of bounded size, one at a time."""
    rows = benchmark.select(F.col(item_col).alias("k"), F.col(text_col).alias("t")).where("t is not null")
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b)
        yield Index(sorted(((r.k, r.t) for r in part.collect()), key=lambda x: (x[0] is None, str(x[0]), x[1])))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row (id, item, first_word, n_words, n_same) for each contaminated
    document and benchmark item."""
    import pyarrow as pa

    sc = docs.sparkSession.sparkContext
    kind = benchmark.schema[item_col].dataType.simpleString()
    out = None
    for index in blocks_of(benchmark, item_col, item_text):
        shared = sc.broadcast(index)

        def make(shared=shared):
            own = shared.value

            def work(batch):
                rows = own.hits(batch.column(text_col).to_pylist())
                return {id_col: batch.column(id_col).take(pa.array([r[0] for r in rows], pa.int64())),
                        "item_id": pa.array([own.keys[r[1]] for r in rows], None if rows else pa.int64()),
                        "first_word": pa.array([r[2] for r in rows], pa.int64()),
                        "n_words": pa.array([r[3] for r in rows], pa.int64()),
                        "n_same": pa.array([r[4] for r in rows], pa.int64())}

            return work

        part = map_arrow(docs.select(id_col, text_col), make,
                         f"item_id {kind}, first_word long, n_words long, n_same long", [id_col])
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", records: int = 512) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    import pyarrow as pa

    schema = docs.schema
    for index in blocks_of(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                hit = {r[0] for r in shared.value.hits(batch.column(text_col).to_pylist())}
                yield batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

        docs = small_batches(docs, records).mapInArrow(released(run), schema)
    return docs
