"""Records that cross the splits of a file: multi-line CSV and JSON arrays.

Both formats can only be cut into records by who knows whether a place lies
inside quotes (CSV), or inside a string and at which depth (JSON).  A reader
that takes a file as a whole therefore takes it in one task.  Here a file is read
in Spark's own splits, as pieces that end at a separator (the line feed, or the
closing brace, which ends every record of a JSON array), in two passes:

1. Every split is scanned once for each state it might start in, and
   gives for each the state at its end and whether a record ends in it.  These
   summaries, one small row a split, are folded in file order: now the state
   at the start of every split is known.
2. Every split is read again from its true state.  Records that begin and end
   in it come out at once.  What is left at its two ends are parts of records
   that cross its borders; parts of one record carry the same number (the
   splits with a record's end before) and are joined by it.

A split that lies inside a single cell or record has no end of any and
passes the state on, so records may be longer than a split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import scan_order
from ..session import ship

ESCAPE = re.compile(r"\\.", re.S)
RECORDS = "file string, block long, at long, head boolean, part long, text string, tail string"


class CsvLexer:
    """Whether a place lies inside quotes; a line feed outside of them ends a record."""

    separator = "\n"

    def summary(self, pieces: Iterator[str]) -> list[tuple[int, int, int]]:
        """(state at the end, change of depth, least depth at a record's end) for a
        start outside and inside of quotes; without depth, an end counts as 0 and none as 1."""
        odd, ends = 0, [1, 1]
        for piece in pieces:
            odd ^= piece.count('"') & 1
            ends[odd] = 0
        # the end of a line with an odd number of quotes before it ends a record if the start was inside
        return [(odd, 0, ends[0]), (odd ^ 1, 0, ends[1])]

    def ends(self, depth: int, least: int) -> bool:
        return least == 0

    def step(self, piece: str, state: int, depth: int) -> tuple[int, int, bool]:
        """(state, depth) behind a piece and its separator, and whether a record ends there."""
        state ^= piece.count('"') & 1
        return state, 0, not state

    def inside(self, state: int, depth: int) -> bool:
        """Whether a split that starts so starts inside a record."""
        return bool(state)

    def over(self, piece: str, state: int, depth: int) -> bool:
        return False


class JsonLexer:
    """Whether a place lies inside a string, and the number of open brackets; a
    closing brace that leaves only the array's bracket open ends a record."""

    separator = "}"

    @staticmethod
    def _depth(piece: str, state: int) -> tuple[int, int]:
        """(state, change of depth) of a piece without its separator."""
        parts = (ESCAPE.sub("", piece) if "\\" in piece else piece).split('"')
        outside = "".join(parts[state::2]) if len(parts) > 1 or not state else ""
        change = outside.count("{") + outside.count("[") - outside.count("]")
        return state ^ (len(parts) - 1 & 1), change

    def summary(self, pieces: Iterator[str]) -> list[tuple[int, int, int]]:
        now = [[0, 0, 1 << 40], [1, 0, 1 << 40]]
        for piece in pieces:
            for s in now:
                s[0], change = self._depth(piece, s[0])
                s[1] += change
                if not s[0]:
                    s[1] -= 1
                    s[2] = min(s[2], s[1])
        return [tuple(s) for s in now]

    def ends(self, depth: int, least: int) -> bool:
        return depth + least <= 1

    def step(self, piece: str, state: int, depth: int) -> tuple[int, int, bool]:
        state, change = self._depth(piece, state)
        depth += change - (0 if state else 1)
        return state, depth, not state and depth == 1

    def inside(self, state: int, depth: int) -> bool:
        return bool(state) or depth > 1

    def over(self, piece: str, state: int, depth: int) -> bool:
        """Whether the array ends in this piece, so that it is the file's last."""
        state, change = self._depth(piece, state)
        return not state and depth + change <= 0


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, at, value): the pieces of every split, in order."""
    return spark.read.option("lineSep", separator).text(path).select(scan_order().alias("o"), "value").select("o.*", "value")


def _runs(batches, columns: tuple[int, ...]):
    """((file, block, ...), iterator of (at, value)) for each split of a partition."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))

    stream = rows()
    row = next(stream, None)
    while row is not None:
        key = tuple(row[k] for k in columns)
        first, row = row, None

        def run():
            nonlocal row
            yield first[2], first[3]
            for row in stream:
                if tuple(row[k] for k in columns) != key:
                    return
                yield row[2], row[3]
            row = None

        got = run()
        yield key, got
        for _ in got:  # what the caller left
            pass


def split_states(found: DataFrame, lexer) -> DataFrame:
    """(file, block, state, depth, ended, last, start): the state at each split's start, the number of
    splits before it in which a record ends, the state behind the file's last split, and
    the first character of the file that is not blank."""

    def scan(batches):
        import pyarrow as pa

        for (file, block), run in _runs(batches, (0, 1)):
            at, first = next(run)
            (a, b, c), (d, e, f) = lexer.summary(chain([first], (v for _, v in run)))
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "start": [first.lstrip("\ufeff \t\r\n")[:1]],
                                              "s0": [a], "d0": [b], "l0": [c], "s1": [d], "d1": [e], "l1": [f]})

    def fold(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        out, state, depth, ended = [], 0, 0, 0
        for r in rows:
            out.append({"file": r["file"], "block": r["block"], "state": state, "depth": depth, "ended": ended})
            end, change, least = (r[f"{x}{state}"] for x in "sdl")
            ended += lexer.ends(depth, least)
            state, depth = end, depth + change
        for r in out:
            r["last"], r["start"] = state, rows[0]["start"]
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("state", pa.int64()), ("depth", pa.int64()), ("ended", pa.int64()), ("last", pa.int64()), ("start", pa.string())]))

    ship(found.sparkSession)
    summaries = found.mapInArrow(scan, "file string, block long, start string, " + ", ".join(f"{x}{s} long" for s in "01" for x in "sdl"))
    return summaries.groupBy("file").applyInArrow(
        fold, "file string, block long, state long, depth long, ended long, last long, start string")


def records(found: DataFrame, states: DataFrame, lexer) -> DataFrame:
    """(file, block, at, head, text, tail): every record with the place of its first
    piece; ``head`` says that it is its file's first.  What a file holds behind its last
    record comes as one row without ``text``, in ``tail``."""

    def cut(batches):
        import pyarrow as pa

        names = ["file", "block", "at", "head", "part", "text", "tail"]
        for (file, block, state, depth, ended), run in _runs(batches, (0, 1, 4, 5, 6)):
            rows, size = [], 0
            text, start, head = [], None, block == 0
            part = ended if lexer.inside(state, depth) else None  # it began in a split before
            over, after = False, ended
            for at, value in run:
                if start is None:
                    start = at
                if over or lexer.over(value, state, depth):
                    over = True
                    text.append(value)
                    continue
                state, depth, end = lexer.step(value, state, depth)
                text.append(value + lexer.separator)
                size += len(value)
                if end:
                    after = ended + 1
                    rows.append((file, block, start, head, part, "".join(text), None))
                    text, start, head, part = [], None, False, None
                    if size > 4_000_000 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)
                        rows, size = [], 0
            if over:
                rows.append((file, block, start, head, part, None, "".join(text)))
            elif text:
                rows.append((file, block, start, head, after, "".join(text), None))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("head", pa.bool_()),
                        ("part", pa.int64()), ("text", pa.string()), ("tail", pa.string())])
    placed = found.join(states.select("file", "block", "state", "depth", "ended"), ["file", "block"]) \
        .select("file", "block", "at", "value", "state", "depth", "ended").sortWithinPartitions("file", "block", "at")
    out = placed.mapInArrow(cut, RECORDS)
    piece = F.struct("block", "at", "head", "text", "tail")
    crossing = (out.where("part is not null").groupBy("file", "part").agg(F.array_sort(F.collect_list(piece)).alias("p"))
                .select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"),
                        F.col("p")[0]["head"].alias("head"), F.array_join(F.col("p.text"), "").alias("text"),
                        F.element_at("p", -1)["tail"].alias("tail")))
    whole = out.where("part is null").drop("part")
    return whole.unionByName(crossing)
