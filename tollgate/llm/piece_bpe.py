"""Piece encoding and decoding: exact merge-type encoding by backtracking.

A model of merge type gives every piece a score; encoding joins, again and
again, the adjacent symbols whose union has the highest score, leftmost first.
The result is the one sequence of pieces in which every piece and every two
neighbours come out of that merging unchanged: while no merge crosses a
border, what happens on its two sides is what would happen there alone.  So
the encoder does not merge whole texts.  An Aho-Corasick automaton over all
pieces gives the longest piece at every position; the encoder goes forward by
longest pieces, checks each against its left neighbour by merging the two
alone (a remembered answer for each pair), takes the next shorter piece where
they do not fit, steps back where none is left, and marks that position in a
bit field, since no result has a border there.

Texts are first cut where no piece joins two neighbouring characters, which
cannot change a result; words so cut are encoded once and remembered, up to
``WORDS`` of them in a task.  Characters without a piece become their UTF-8
bytes where the model has byte pieces, else the unknown piece.

Decoding joins the pieces, drops the first piece's one leading space mark,
turns marks into spaces and runs of byte pieces into characters, with U+FFFD
for each byte of an invalid run; control pieces vanish.

A task maps its texts on its own: one scan, no shuffle, whatever the skew.

Defined results: a null text counts as empty and gives no ids and an empty
text; repeated rows are encoded each; a text of any length is encoded whole;
other columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SPACE = "▁"  # U+2581, the mark of a space
MODEL = "piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)

#: Remembered words and pairs of a task; only the work depends on it.
WORDS, PAIRS, LONGEST_WORD = 600_000, 500_000, 64


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _message(raw: bytes):
    """(field number, value) pairs of one encoded message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class Pieces:
    """The pieces of a model file, with an encoder and a decoder."""

    def __init__(self, raw: bytes):
        import ahocorasick

        self.names: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        kind_of_model, self.prefix, self.unknown_text, marks = 1, True, " ⁇ ", True
        for field, value in _message(raw):
            if field == 1:
                got = dict(_message(value))
                self.names.append(got.get(1, b"").decode())
                scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
            elif field == 2:
                got = dict(_message(value))
                kind_of_model = got.get(3, 1)
                if 44 in got:
                    self.unknown_text = got[44].decode()
                marks = not got.get(24, 0)
            elif field == 3:
                got = dict(_message(value))
                self.prefix = bool(got.get(3, 1))
                if got.get(2) or got.get(4, 1) or not got.get(5, 1):
                    raise ValueError("models that rewrite characters or spaces are not supported")
        if kind_of_model != 2 or not marks or {USER, UNUSED} & set(self.kinds):
            raise ValueError("only models of merge type with normal, byte and control pieces are supported")
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.bytes = {int(self.names[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {s: i for i, (s, k) in enumerate(zip(self.names, self.kinds)) if k == NORMAL}
        self.score = {s: scores[i] for s, i in self.ids.items()}
        self.plain = [k == NORMAL for k in self.kinds]

        # pieces that merging never reaches are in no result
        whole = [p for p in self.ids if len(self.merged(p)) == 1]
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        known = set(whole)
        self.shorter = {p: next(p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in known)
                        for p in whole if len(p) > 1}
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        inside = {c for pair in self.joined for c in pair}
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in inside))
        past = any(pair[1] == SPACE != pair[0] for pair in self.joined)  # pieces that go on past a space
        cut = f"[^{alone}]+" if past else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"
        self.word = re.compile(f"{cut}|[{alone}]" if alone else cut)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, tuple[array, str]] = {}
        self._units: dict[str, tuple[array, str]] = {}

    def merged(self, s: str) -> list[str]:
        """Plain merging of a short string: best score first, leftmost of equals."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = score.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or got > best):
                    best, at = got, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two adjacent pieces stay as they are when merged alone."""
        key = (left, right)
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            got = self._pairs[key] = self.merged(left + right) == [left, right]
        return got

    def split(self, s: str) -> list[str]:
        """The pieces of a string without spaces to add, by backtracking."""
        longest = list(s)
        for end, (back, piece) in self.automaton.iter(s):
            longest[end - back] = piece  # of one start, later ends are longer
        out: list[str] = []
        failed, pairs, shorter, size, at = None, self._pairs, self.shorter, len(s), 0
        left, piece = "", longest[0]
        while True:
            end = at + len(piece)
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                fits = not left or pairs.get((left, piece))
                if fits or fits is None and self.fits(left, piece):
                    out.append(piece)
                    if end == size:
                        return out
                    at, left, piece = end, piece, longest[end]
                    continue
            if piece in shorter:
                piece = shorter[piece]
            else:
                if failed is None:
                    failed = bytearray((size >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                left = out[-1] if out else ""

    def of_unit(self, s: str) -> tuple[array, str]:
        """(ids, decoded text) of characters that pieces may join."""
        got = self._units.get(s)
        if got is None:
            ids = array("i")
            for piece in self.split(s):
                i = self.ids.get(piece)
                if i is not None:
                    ids.append(i)
                elif self.bytes:
                    ids.extend([self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")])
                else:
                    ids.append(self.unknown)
            got = ids, self.joined_text(ids)
            if len(s) <= LONGEST_WORD:
                if len(self._units) >= WORDS:
                    self._units.clear()
                self._units[s] = got
        return got

    def of_word(self, s: str) -> tuple[array, str]:
        """(ids, decoded text) of one word as the encoder cuts them."""
        got = self._words.get(s)
        if got is None:
            joined = self.joined
            cuts = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in joined]
            if cuts:
                ids, texts = array("i"), []
                for a, b in zip([0, *cuts], [*cuts, len(s)]):
                    part, text = self.of_unit(s[a:b])
                    ids.extend(part)
                    texts.append(text)
                got = ids, "".join(texts)
            else:
                got = self.of_unit(s)
            if len(s) <= LONGEST_WORD:
                if len(self._words) >= WORDS:
                    self._words.clear()
                self._words[s] = got
        return got

    def words(self, text: str) -> list[str]:
        return self.word.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        for w in self.words(text or ""):
            out.extend(self.of_word(w)[0])
        return out.tolist()

    def joined_text(self, ids: list[int]) -> str:
        """The text of ids inside a sequence: nothing is dropped at its start."""
        names, plain = self.names, self.plain
        if all(map(plain.__getitem__, ids)):
            return "".join([names[i] for i in ids]).replace(SPACE, " ")
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
            if i >= 0 and self.kinds[i] == UNKNOWN:
                out.append(self.unknown_text)
            elif i >= 0 and self.kinds[i] != CONTROL:
                out.append(self.names[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of a whole sequence, without the mark put before its first word."""
        text = self.joined_text(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), self.unknown)
        return text[1:] if self.prefix and self.names[first].startswith(SPACE) else text


def _characters(run: bytes) -> str:
    """The characters of a run of bytes; a byte that begins none is U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


_HELD: dict[bytes, Pieces] = {}


def _held(raw: bytes) -> Pieces:
    """One encoder in a worker, with its bounded memory of words, for all its tasks."""
    key = hashlib.sha256(raw).digest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Pieces(raw)
    return _HELD[key]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' ids with ``ids`` (array of int) and ``decoded`` (the text the ids
    give back).  The model file (a bounded vocabulary) goes to the tasks in the job."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(model_bytes(path))

    def make():
        import numpy as np
        import pyarrow as pa

        pieces = _held(model.value)
        skip = 1 if pieces.prefix else 0

        def work(batch):
            ids, sizes, texts = array("i"), [0], []
            for text in batch.column(1).to_pylist():
                got = [pieces.of_word(w) for w in pieces.words(text or "")]
                for part, _ in got:
                    ids.extend(part)
                sizes.append(len(ids))
                texts.append("".join([t for _, t in got])[skip:])
            return {id_col: batch.column(0), "decoded": pa.array(texts, pa.string()),
                    "ids": pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(np.frombuffer(ids, np.int32)))}
        return work

    return map_arrow(docs.select(id_col, text_col), make, "ids array<int>, decoded string", [id_col], 128)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of ids, and hashes of the ids and of the decoded text."""
    return encoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
