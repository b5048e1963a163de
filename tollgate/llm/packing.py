"""Sequence packing as vector bin packing with the dot-product heuristic.

A sequence has room in three dimensions: tokens, segments and loss-bearing
tokens.  The open sequence takes, of all pieces that fit in every dimension, the
one whose demand has the largest dot product with the room left, each
dimension weighted by the demand of the whole pool for it.  So long pieces go
first while there is room, and pieces with many loss-bearing tokens go where
that room is left.

Examples of instruction data stay whole (``pack_examples``).  Documents may be
cut (``pack_documents``): full sequences are cut off a long document at once, only
rests go to the pool; where no piece fits, one is cut to fill the sequence.
What is left at a task's end, or beside a sequence whose other limits are
reached, is laid out in sequences of a power of two, which need no padding.

Each task packs its own rows from a pool of at most ``POOL`` pieces, so
memory is bounded and nothing is shuffled.  Sequence ids hold the task's
partition in their upper bits; a task run again makes the same rows again.

Defined results: a null or empty text is its closing id alone; null or empty
examples take a segment of no tokens (``pack_examples``); equal rows are packed
each; an example longer than a sequence is cut into pieces of a sequence's
size; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import released, small_batches
from .jaccard_join import TextSets

TOKENS, SEGMENTS, LOSS = 2048, 256, 2048
POOL = 1024
END_ID = 1
#: Bytes of text encoded together.
PIECE, BLANK = 1 << 20, re.compile(rb"[\x20\x09-\x0d]")
VOCABULARY = "word_bpe_49k.json"


class DocumentIds:
    """Ids of texts; those of stretches between blanks are kept, by 64-bit hashes of
    their bytes.

    The vocabulary's normaliser and splitter never join characters across white
    space, so the ids of a text are those of its stretches in turn.  New stretches of
    Latin letters, digits and signs are split together by the vocabulary's own rule and
    their words go straight to the model; others go through the whole tokenizer, and so
    do texts with characters that Python and the tokenizer may not both take for
    white space, or with the text of a special token."""

    WHOLE = re.compile("[\x1c-\x1f\x85]|<\\|")
    #: No apostrophes (they have rules of their own), no other numbers than digits,
    #: nothing that normalisation or lower-casing makes several characters.
    OTHER = re.compile("[^\n!-&(-~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]")
    WORD = re.compile(r"\n|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str | None = None, limit: int = 500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = limit
        self.words: dict[str, bytes] = {}
        self.sets = TextSets()
        self._forget()
        # the byte-level alphabet: printable bytes stand for themselves, the
        # others for the characters from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}

    def _forget(self) -> None:
        """No stretch is known."""
        self.hashes, self.ids = np.zeros(0, np.uint64), np.zeros(0, "<u4")
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Keeps the ids of new words."""
        new = [w for w in words if w not in self.words]
        for k in range(0, len(new), 20_000):
            part = new[k:k + 20_000]
            mapped = " ".join(w if w.isascii() else "".join(map(self.alphabet.__getitem__, w.encode())) for w in part)
            ids = np.array(self.plain.encode(mapped, add_special_tokens=False).ids, dtype="<u4")
            raw, stops = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            assert len(stops) == len(part)
            self.words.update((w, raw[a:b]) for w, a, b in zip(part, [0, *stops], stops))

    def _unknown(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each) of new stretches, all split and looked up together."""
        text = b"\n".join(stretches).decode("utf-8", "surrogatepass")
        if self.OTHER.search(text):
            found = [np.zeros(0, "<u4")] * len(stretches)
            names = text.split("\n")
            plain = [k for k, w in enumerate(names) if not self.OTHER.search(w)]
            if plain:
                ids, sizes = self._unknown([stretches[k] for k in plain])
                for k, part in zip(plain, np.split(ids, np.cumsum(sizes)[:-1])):
                    found[k] = part
            for k in set(range(len(names))).difference(plain):
                found[k] = np.frombuffer(self._encode(names[k]), dtype="<u4")
            return np.concatenate(found), np.array([len(f) for f in found], dtype=np.int64)
        parts = self.WORD.findall(text.lower() + "\n")
        if len(self.words) > self.limit:
            self.words = {}
        self.words["\n"] = b""
        self._learn(set(parts))
        got = list(map(self.words.__getitem__, parts))
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        ends = np.cumsum(sizes)[np.fromiter((k for k, w in enumerate(parts) if w == "\n"), np.int64, len(stretches))]
        return np.frombuffer(b"".join(got), dtype="<u4"), np.diff(np.r_[0, ends])

    def _piece(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, the start of each stretch, ids before each stretch and in all) of a piece that
        ends with a blank.  Stretches are known by 64-bit hashes."""
        h, start, end = self.sets.words(raw)
        new, first, place = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > self.limit:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, new), max(len(self.hashes) - 1, 0))
        found = self.hashes[at] == new if len(self.hashes) else np.zeros(len(new), bool)
        if not found.all():
            ids, sizes = self._unknown([raw[a:b] for a, b in zip(start[first[~found]].tolist(), end[first[~found]].tolist())])
            begin = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, ids])
            into = np.searchsorted(self.hashes, new[~found])
            self.hashes, self.begin, self.size = (np.insert(x, into, y) for x, y in (
                (self.hashes, new[~found]), (self.begin, begin), (self.size, sizes)))
            at = np.searchsorted(self.hashes, new)
        begin, size = self.begin[at][place], self.size[at][place]
        stops = np.cumsum(size)
        where = np.repeat(begin - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)
        return self.ids[where], start, np.r_[0, stops]

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the closing one."""
        out: list[np.ndarray | None] = [None] * len(texts)
        end, held, size = np.array([END_ID], dtype="<u4"), [], 0

        def flush():
            ids, start, before = self._piece(b" ".join([raw for _, raw in held]) + b" ")
            stops = before[np.searchsorted(start, np.cumsum([len(raw) + 1 for _, raw in held]))].tolist()
            for (k, _), a, b in zip(held, [0, *stops], stops):
                out[k] = np.concatenate([ids[a:b], end])
            held.clear()

        for k, t in enumerate(texts):
            if not t or self.WHOLE.search(t):
                raw = self._encode(t) if t else b""
                out[k] = np.concatenate([np.frombuffer(raw, dtype="<u4"), end])
                continue
            raw = t.encode("utf-8", "surrogatepass")
            if len(raw) > PIECE:
                out[k] = np.concatenate([*(self._piece(p)[0] for p in _cut(raw)), end])
                continue
            if size + len(raw) > PIECE and held:
                flush()
                size = 0
            held.append((k, raw))
            size += len(raw) + 1
        if held:
            flush()
        return out


def _cut(raw: bytes):
    """A long text in pieces that end with a blank."""
    at = 0
    while at < len(raw):
        stop = BLANK.search(raw, min(at + PIECE, len(raw)))
        stop = stop.end() if stop else len(raw)
        yield raw[at:stop] + b" "
        at = stop


_ENCODERS: dict[str | None, DocumentIds] = {}


def encoder(path: str | None = None) -> DocumentIds:
    """One encoder in a worker for all its tasks, so that words are learnt once; it
    keeps at most ``limit`` of them, and as many stretches."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = DocumentIds(path)
    return _ENCODERS[path]


@dataclass
class Piece:
    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray  # whether a token bears loss
    total: int

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.key, self.start, self.ids[:n], self.loss[:n], self.total),
                Piece(self.key, self.start + n, self.ids[n:], self.loss[n:], self.total))


class Packer:
    """Takes examples, gives rows (key, start, piece, sequence, offset)."""

    def __init__(self, first_id: int, cut: bool, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS):
        if min(tokens, segments, loss) < 1:
            raise ValueError("a sequence needs room in every dimension")
        self.next, self.may_cut = first_id, cut
        self.limits = np.array([tokens, segments, loss], dtype=np.int64)
        self.pool: list[Piece] = []
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray, loss: np.ndarray) -> None:
        piece = Piece(key, 0, ids, loss, len(ids))
        size = int(self.limits[0])
        while len(piece.ids) > size or (self.may_cut and len(piece.ids) == size):
            if int(np.count_nonzero(piece.loss[:size])) > self.limits[2]:
                break
            head, piece = piece.cut(size)
            self._emit([head])
            if not len(piece.ids):
                return
        self.pool.append(piece)

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((p, self.next, offset))
            offset += len(p.ids)
        self.next += 1

    def _head(self, piece: Piece, room: np.ndarray) -> int:
        """Tokens of the piece's beginning that fit the room."""
        n = min(len(piece.ids), int(room[0]))
        if np.count_nonzero(piece.loss[:n]) > room[2]:
            n = int(np.searchsorted(np.cumsum(piece.loss[:n]), room[2], "right"))
        return n

    def pack(self, down_to: int) -> None:
        """Fills sequences until ``down_to`` pieces are left (0: none)."""
        while len(self.pool) > down_to:
            pool = self.pool
            demand = np.array([[len(p.ids), 1, np.count_nonzero(p.loss)] for p in pool], dtype=np.int64)
            weight = demand.sum(axis=0) / self.limits / self.limits
            free = np.ones(len(pool), dtype=bool)
            while free.any() and (free.sum() > down_to or not down_to):
                free = self._one(pool, demand, weight, free, down_to)
            self.pool = [p for p, f in zip(pool, free) if f]

    def _one(self, pool, demand, weight, free, down_to) -> np.ndarray:
        """Fills one sequence."""
        room, mine = self.limits.copy(), []
        while room[0] > 0 and room[1] > 0:
            fits = free & (demand <= room).all(axis=1)
            if fits.any():
                k = int(np.where(fits, demand @ (weight * room / self.limits), -1.0).argmax())
                free[k] = False
                mine.append(pool[k])
                room -= demand[k]
                continue
            if not (self.may_cut or not mine) or not free.any():
                break
            k = int(np.where(free, demand[:, 0], -1).argmax())
            n = self._head(pool[k], room)
            if not n:
                break
            head, pool[k] = pool[k].cut(n)
            mine.append(head)
            demand[k] = [len(pool[k].ids), 1, np.count_nonzero(pool[k].loss)]
            room -= [n, 1, np.count_nonzero(head.loss)]
        if self.may_cut and room[0] > 0:
            # neither full nor fillable: whole powers of two, so without padding
            size, left = int(self.limits[0] - room[0]), mine
            for bit in reversed(range(size.bit_length())):
                if size >> bit & 1:
                    want, part = 1 << bit, []
                    while want:
                        p = left.pop(0)
                        if len(p.ids) > want:
                            p, rest = p.cut(want)
                            left.insert(0, rest)
                        part.append(p)
                        want -= len(p.ids)
                    self._emit(part)
        else:
            self._emit(mine)
        return free


def _run(df: DataFrame, id_col: str, columns: list[str], read, cut: bool, limits: tuple, records: int) -> DataFrame:
    """``read()`` gives in each task a function from a batch to (ids, loss) pairs."""
    import pyarrow as pa

    key = df.schema[id_col]
    schema = T.StructType([key] + T.StructType.fromDDL(
        "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long").fields)

    def run(batches):
        from pyspark import TaskContext

        work = read()
        packer = Packer(TaskContext.get().partitionId() << 40, cut, *limits)

        def rows(kind):
            got, packer.rows = packer.rows, []
            cols = [pa.array([p.key for p, _, _ in got], kind)]
            for value in (lambda p: p.start, lambda p: len(p.ids), lambda p: zlib.crc32(p.ids.tobytes()), lambda p: p.total):
                cols.append(pa.array([value(p) for p, _, _ in got], pa.int64()))
            cols.append(pa.array([s for _, s, _ in got], pa.int64()))
            cols.append(pa.array([o for _, _, o in got], pa.int64()))
            cols.append(pa.array([int(np.count_nonzero(p.loss)) for p, _, _ in got], pa.int64()))
            return pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

        kind = None
        for batch in batches:
            kind = batch.column(id_col).type
            for k, (ids, loss) in zip(batch.column(id_col).to_pylist(), work(batch)):
                packer.add(k, ids, loss)
                if len(packer.pool) >= POOL:
                    packer.pack(POOL // 4)
            yield rows(kind)
        if kind is not None:
            packer.pack(0)
            yield rows(kind)

    return small_batches(df.select(id_col, *columns), records).mapInArrow(released(run), schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS,
                   segments: int = SEGMENTS, loss: int = LOSS, tokenizer_path: str | None = None) -> DataFrame:
    """A row for each piece of each document; all ids but a document's first
    bear loss."""

    def read():
        ids_of = encoder(tokenizer_path).of

        def work(batch):
            for ids in ids_of(batch.column(text_col).to_pylist()):
                bears = np.ones(len(ids), dtype=bool)
                bears[0] = False
                yield ids, bears

        return work

    return _run(docs, id_col, [text_col], read, True, (tokens, segments, loss), 256)


def pack_examples(examples: DataFrame, id_col: str, ids_col: str, loss_col: str, tokens: int = TOKENS,
                  segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """The same for examples given as arrays of ids and of loss flags, whole."""

    def read():
        def work(batch):
            for ids, bears in zip(batch.column(ids_col).to_pylist(), batch.column(loss_col).to_pylist()):
                ids = np.array(ids or [], dtype="<u4")
                flags = np.zeros(len(ids), dtype=bool)
                flags[:len(bears or [])] = [bool(b) for b in (bears or [])[:len(ids)]]
                yield ids, flags

        return work

    return _run(examples, id_col, [ids_col, loss_col], read, False, (tokens, segments, loss), 256)
