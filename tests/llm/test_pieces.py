"""Piece encoding and decoding against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tollgate.llm import piece_bpe, queries

from test_operators import AWKWARD, SF, data, docs  # noqa: F401


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))


@pytest.fixture(scope="module")
def pieces():
    return piece_bpe.Pieces(piece_bpe.model_bytes())


def test_random_texts(library, pieces):
    rnd = random.Random(1)
    alphabet = "  ▁▁ab cdeth\n\t.,<>0s/é漢字🙂ข\x00﻿‍"
    for k in range(4000):
        n = rnd.choice([0, 1, 2, 5, 10, 40])
        text = "".join(rnd.choices(alphabet, k=n)) if k % 2 else "".join(rnd.choices(pieces.names[3:], k=n // 3 + 1))
        ids = library.encode(text)
        assert pieces.encode(text) == ids, text
        assert pieces.decode(ids) == library.decode(ids), text


def test_decoding_of_any_ids(library, pieces):
    rnd = random.Random(2)
    for _ in range(4000):
        ids = [rnd.choice((rnd.randrange(32000), rnd.randrange(260), rnd.randrange(3))) for _ in range(rnd.randrange(8))]
        assert pieces.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 5000, " " * 3001, "\n" * 999, "é" * 2000, "the" * 3000, "abcdefghij" * 800])
def test_long_runs(library, pieces, text):
    assert pieces.encode(text) == library.encode(text)


def test_every_split_is_checked(pieces):
    """A word where the longest first piece leads nowhere is stepped back from."""
    rnd = random.Random(3)
    back = 0
    for _ in range(300):
        s = "".join(rnd.choices("aeinrst", k=12))
        want = pieces.merged(s)
        assert pieces.split(s) == want
        back += not s.startswith(max((p for p in pieces.ids if s.startswith(p)), key=len)) or \
            want[0] != max((p for p in pieces.ids if s.startswith(p)), key=len)
    assert back > 10


def test_cuts_and_forgetting_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "WORDS", 3)
    monkeypatch.setattr(piece_bpe, "PAIRS", 3)
    small = piece_bpe.Pieces(piece_bpe.model_bytes())
    text = "some words, some other words; some words again 123 45.6"
    assert small.encode(text) == library.encode(text)


def want(library, text):
    ids = library.encode(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_awkward_tables(spark, docs, library):  # noqa: F811
    clash = docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")).withColumn("n_tokens", F.lit(0))
    got = sorted(piece_bpe.digests(piece_bpe.encode(clash)).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted(((i, *want(library, t)) for i, t in AWKWARD), key=str)
    texts = piece_bpe.encode(docs).where("doc_id = 8").first()
    assert texts.decoded == AWKWARD[10][1] and texts.ids == library.encode(AWKWARD[10][1])
    assert piece_bpe.digests(piece_bpe.encode(docs.limit(0))).collect() == []


@data
def test_query_equals_the_library(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_piece_bpe(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == {r.doc_id: want(library, r.text) for r in texts} and len(got) == 200
