"""Phrase collocations: Misra-Gries summaries, then exact counts.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line breaks, and
the pieces into words.  Every stretch of one to ``LONGEST`` words inside a piece
is an occurrence, counted for each language.  The occurrences of one length are
dealt into hash partitions; their number follows from the bytes of all texts, so
that a partition holds at most about ``MASS`` of them.

First pass, one length after another: a task counts the occurrences of ``FLUSH`` words at a
time and sends each partition's summary (hashes and counts) there, with its mass.  The
receiver merges summaries with the Misra-Gries rule: with more than k counters, the
(k+1)-th largest count is taken off all of them.  All that is taken off any phrase is below
mass / (k + 1), and k exceeds the partition's mass divided by ``least``, so every
phrase that occurs ``least`` times keeps a counter.  What keeps one is marked in a bit map of
at most 2^``BITS`` bits, whatever the input's size, which goes to all tasks.  A longer phrase is
counted only where both shorter phrases inside it are marked, as a frequent one's are.
Second pass: the marked phrases are counted exactly, by their words and not by hashes.  A
map too full to tell phrases apart lets more of them through and changes no result.

Every part of a frequent phrase is frequent itself, so the scores need nothing
but the table of exact counts.  A hot word is one entry of a task's
summary, however often it occurs, and a partition's memory is bounded by ``MASS``.

Defined results: a null text counts as empty, a null language as ``UND``; a
phrase needs ``least`` occurrences in all, repeated rows count each; equal scores
rank by count, then by the phrase's bytes; equal cuts by the smallest first
part; a text of any length counts whole; other columns are ignored, whatever their
names; an empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import blake2b
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small_batches, written

UND = "und"
LEAST, LONGEST, COVER, KEEP = 10, 3, 50, 2000
MASS = 16_000_000  # occurrences in a hash partition
BITS = 27  # log2 of a bit map's size, at most
FLUSH = 500_000  # words counted at a time
STRETCH = 4_000_000  # bytes of a text tokenised at a time
ENTRIES = 2048  # phrases in a row of a summary

BREAK = b"\xff"  # in no UTF-8 text
#: A-Z lower-cased, the bytes that end a piece and the tab replaced.
TABLE = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r\t", LOWER.encode() + BREAK * 10 + b" ")

SUMMARY = "part int, kind int, mass long, lang string, h array<int>, c array<int>"
MARKED = "part int, bits binary, lang string, n long"


def stretches(text: bytes):
    """A translated text in stretches that end with a piece."""
    at = 0
    while len(text) - at > STRETCH and (cut := text.find(BREAK, at + STRETCH)) >= 0:
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One more word's hash mixed into the hashes of word sequences."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


class Marks:
    """A bit map over the first ``bits`` bits of 64-bit hashes."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.data = np.zeros(1 << bits - 3, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Occurrences:
    """Counts of the word sequences of some texts, by language."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number = defaultdict(count().__next__)
        self.number[BREAK]  # is 0
        self.ids: dict[str, list[np.ndarray]] = defaultdict(list)
        self.words = 0

    def add(self, lang: str, text: bytes) -> None:
        """A stretch of a translated text."""
        tokens = text.replace(BREAK, b" \xff ").split()
        tokens.append(BREAK)
        self.ids[lang].append(np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens)))
        self.words += len(tokens)

    def counted(self, marks: list[Marks], sizes: range):
        """(language, size, hashes, counts, word numbers by place) of the sequences of each
        of the ``sizes`` that ``marks`` (one for each length from 1 on) let through."""
        size = len(self.number)
        hashes = np.fromiter(map(word_hash, self.number), np.uint64, size)
        for lang, got in self.ids.items():
            ids = np.concatenate(got)
            key, good = ids, ids > 0
            h = mixed(np.full(1, word_hash(lang.encode("utf-8", "surrogatepass")), np.uint64), hashes[ids])
            for n in range(1, sizes.stop):
                if n > 1:
                    if int(key.max(initial=0)) + 1 > 2**62 // size:
                        key = np.unique(key, return_inverse=True)[1]
                    key = key[:-1] * size + ids[n - 1 :]
                    h = mixed(h[:-1], hashes[ids[n - 1 :]])
                    good = good[:-1] & good[1:]
                if n <= len(marks):
                    good = good & marks[n - 1].has(h)
                if n in sizes and len(at := np.flatnonzero(good)):
                    _, first, times = np.unique(key[at], return_index=True, return_counts=True)
                    at = at[first]
                    yield lang, n, h[at], times, [ids[at + k] for k in range(n)]


def _flushed(batches, make, flush: int = FLUSH):
    """Feeds batches of (language, bytes) and yields ``make(occurrences)`` at each flush."""
    got = Occurrences()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for stretch in stretches(text.as_py().translate(TABLE)):
                got.add(lang, stretch)
                if got.words >= flush:
                    yield from make(got)
                    got.clear()
    if got.words:
        yield from make(got)


def _rows(h: np.ndarray, c: np.ndarray, parts: int, lang: str):
    """A flush's summary rows: one of kind 0 with the mass of each part, and
    rows of kind 1 with at most ``ENTRIES`` counters.  A hash's first ``parts`` bits name
    the part, the next 32 the counter; a shared counter is only a counter too many."""
    import pyarrow as pa

    part = (h >> np.uint64(64 - parts)).astype(np.int32) if parts else np.zeros(len(h), np.int32)
    key = ((h << np.uint64(parts)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    order = np.argsort(part, kind="stable")
    part, key, c = part[order], key[order], c[order].astype(np.int32)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    sizes = np.diff(np.r_[starts, len(part)])
    steps = -(-sizes // ENTRIES)
    inner = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    at = np.r_[np.repeat(starts, steps) + inner * ENTRIES, len(part)].astype(np.int32)
    for kind, rows in ((0, starts), (1, at[:-1])):
        n = len(rows)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) if kind else pa.nulls(n, pa.list_(pa.int32())) for x in (key, c)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[rows]), pa.array(np.full(n, kind, np.int32)), pa.array(np.add.reduceat(c, rows, dtype=np.int64)),
             pa.array([lang] * n, pa.string()), *lists], names=["part", "kind", "mass", "lang", "h", "c"])


def summaries(texts: DataFrame, size: int, parts: int, marks: list, flush: int = FLUSH) -> DataFrame:
    """Summary rows of the sequences of ``size`` words in ``texts`` (lang, text as bytes)."""

    def run(batches):
        known = [Marks(bits, data.value) for bits, data in marks]

        def make(got):
            for lang, _, h, c, _ in got.counted(known, range(size, size + 1)):
                yield from _rows(h, c, parts, lang)

        yield from _flushed(batches, make, flush)

    return small_batches(texts, 512).mapInArrow(run, SUMMARY)


class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters between merges."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.h, self.c = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.entries = 0
        self.taken = 0  # off every count so far

    def add(self, h: np.ndarray, c: np.ndarray) -> None:
        self.waiting.append((h, c))
        self.entries += len(h)
        if self.entries > max(self.capacity, 1_000_000):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        h = np.concatenate([self.h, *(x[0] for x in self.waiting)])
        c = np.concatenate([self.c, *(x[1] for x in self.waiting)])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        h, c = h[starts], np.add.reduceat(c, starts, dtype=np.int64)
        if len(h) > self.capacity:
            off = np.partition(c, len(c) - self.capacity - 1)[len(c) - self.capacity - 1]
            c -= off
            self.taken += int(off)
            h, c = h[c > 0], c[c > 0]
        self.h, self.c, self.waiting, self.entries = h, c, [], 0


def survivors(partials: DataFrame, parts: int, bits: int, least: int = LEAST) -> DataFrame:
    """(part, its piece of the bit map) and (lang, mass of the language in the part)."""

    def run(batches):
        import pyarrow as pa

        def out(part, masses, summary):
            summary.merge()
            piece = np.zeros(1 << bits - parts - 3, np.uint8)
            at = summary.h >> np.uint32(32 - (bits - parts))
            np.bitwise_or.at(piece, at >> np.uint32(3), np.uint8(1) << (at & np.uint32(7)).astype(np.uint8))
            n = len(masses)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * (n + 1), pa.int32()), pa.array([piece.tobytes()] + [None] * n, pa.binary()),
                 pa.array([None, *masses], pa.string()), pa.array([None, *masses.values()], pa.int64())],
                names=["part", "bits", "lang", "n"])

        now, masses, summary = None, {}, None
        for batch in batches:
            h, c = batch.column(4), batch.column(5)
            rows = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3)))
            for k, (part, kind, mass, lang) in enumerate(rows):
                if part != now:
                    if summary is not None:
                        yield from out(now, masses, summary)
                    now, masses, summary = part, {}, None
                if kind == 0:  # of one part, masses come first
                    masses[lang] = masses.get(lang, 0) + mass
                    continue
                if summary is None:
                    summary = Summary(sum(masses.values()) // least + 1)
                # copied, so that a waiting summary does not hold its batch
                summary.add(h[k].values.to_numpy().view(np.uint32).copy(), c[k].values.to_numpy().copy())
        if summary is not None:
            yield from out(now, masses, summary)

    dealt = partials.repartition("part").sortWithinPartitions("part", "kind")
    return small_batches(dealt, 512).mapInArrow(run, MARKED)


def exact(texts: DataFrame, marks: list, longest: int = LONGEST, least: int = LEAST, flush: int = FLUSH) -> DataFrame:
    """(lang, phrase, f) of every phrase with ``least`` occurrences, counted by its words."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known = [Marks(bits, data.value) for bits, data in marks]

        def make(got):
            names = pa.array(list(got.number)[1:], pa.binary()).cast(pa.string())
            for lang, _, _, c, places in got.counted(known, range(1, longest + 1)):
                cols = [names.take(pa.array(p - 1)) for p in places]
                phrase = cols[0] if len(cols) == 1 else pc.binary_join_element_wise(*cols, " ")
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(c)), phrase, pa.array(c, pa.int64())],
                                                 names=["lang", "phrase", "f"])

        yield from _flushed(batches, make, flush)

    found = small_batches(texts, 512).mapInArrow(run, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, mass: int = MASS,
             flush: int = FLUSH) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases with ``least`` occurrences, (lang, n) with the number of words)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(UND)).alias("lang"),
                        F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(BITS, max(12, size.bit_length()))
    # a word and the byte that ends it are two bytes at least
    parts = min(bits - 3, max(0, (size // (2 * mass)).bit_length()))
    marks, total = [], None
    for n in range(1, longest + 1):
        kept = written(survivors(summaries(texts, n, parts, marks, flush), parts, bits, least), f"phrase-marks-{n}")
        if total is None:
            total = kept.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
        # the bit map: 2^(bits - 3) bytes in all, at any size of the input
        data = bytearray(1 << bits - 3)
        step = len(data) >> parts
        for r in kept.where("bits is not null").select("part", "bits").toLocalIterator():
            data[r.part * step : (r.part + 1) * step] = r.bits
        marks.append((bits, spark.sparkContext.broadcast(bytes(data))))
    return written(exact(texts, marks, longest, least, flush), "phrases"), total


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, keep: int = KEEP, mass: int = MASS,
                 flush: int = FLUSH) -> DataFrame:
    """Each language's first ``keep`` phrases of two or three words by score."""
    counts, total = frequent(docs, least, LONGEST, mass, flush)
    sized = counts.withColumn("words", F.size(F.split("phrase", " ")))
    candidates = sized.where("words >= 2")
    pair = F.struct(F.lit(1).alias("k"), F.substring_index("phrase", " ", 1).alias("left"),
                    F.when(F.col("words") == 2, F.substring_index("phrase", " ", -1))
                    .otherwise(F.substring_index("phrase", " ", -2)).alias("right"))
    second = F.struct(F.lit(2).alias("k"), F.substring_index("phrase", " ", 2).alias("left"),
                      F.substring_index("phrase", " ", -1).alias("right"))
    cuts = candidates.select("lang", "phrase", "f", F.explode(
        F.when(F.col("words") == 2, F.array(pair)).otherwise(F.array(pair, second))).alias("cut")) \
        .select("lang", "phrase", F.col("f").alias("a"), "cut.*")
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = "cast({} as decimal(16,0))".format
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).withColumn("score", F.expr(
        f"cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")) \
        .select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    inside = candidates.where("words = 3").select("lang", "f", F.explode(F.array(
        F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = free.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= keep)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH texts AS (
  SELECT coalesce(lang, '{UND}') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM texts),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]'), lambda x: x <> '') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang),
places AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3)) AS s(size) WHERE len(ws) >= size),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= {LEAST}),
split AS (SELECT *, string_split(phrase, ' ') AS ws FROM counts WHERE size >= 2),
cuts AS (
  SELECT lang, phrase, f AS a, size, k, array_to_string(ws[1:k], ' ') AS lft, array_to_string(ws[k + 1:], ' ') AS rgt
  FROM split, (VALUES (1), (2)) AS s(k) WHERE k < size),
scored AS (
  SELECT cuts.*, p.f AS l, q.f AS r, (1000000::HUGEINT * a * a // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM cuts JOIN counts p ON p.lang = cuts.lang AND p.phrase = lft JOIN counts q ON q.lang = cuts.lang AND q.phrase = rgt),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(ws[1:2], ' ') AS part FROM split WHERE size = 3
    UNION ALL SELECT lang, f, array_to_string(ws[2:3], ' ') FROM split WHERE size = 3) GROUP BY ALL),
free AS (
  SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND part = phrase
  WHERE longer IS NULL OR 100 * longer < {COVER} * a)
SELECT free.lang, row_number() OVER (PARTITION BY free.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM free JOIN total ON total.lang = free.lang
QUALIFY rank <= {KEEP}
"""
