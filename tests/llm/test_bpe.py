from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from glossa.llm import bpe

PATH = P.path("byte_bpe_50k.json")
ALPHABET = "ab 's'll\n\t \r  .é漢字\U0001f60012²½_\x1c\x85\xa0​'d  AAAA<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n=3000):
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 3000, "\n" * 500, " " * 333 + "x", "the " * 4000]


def test_ids_and_decoded_texts_are_the_librarys(library):
    codec = bpe.Codec(PATH)
    for t, ids in zip(texts(), codec.encode(texts()), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False) == t


def test_a_full_table_of_chunks_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 50)
    small, large = bpe.Codec(PATH), bpe.Codec(PATH)
    xs = texts(200)
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 50)
    assert [small.encode([x])[0] for x in xs] == large.encode(xs)


def test_ids_that_are_no_text_decode_with_replacement(library):
    ids = [np.uint32(i) for i in (i for i, b in enumerate(bpe.codec(PATH).token) if b == b"\xe2")]
    assert bpe.codec(PATH).decode(np.array(ids, dtype="<u4").tobytes()) == library.decode(list(map(int, ids)))


def test_frames(spark, library):
    rows = [(1, None, "x"), (None, "two  words", "x"), (1, None, "x"), (2, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r["doc_id"], r["n_tokens"]) for r in bpe.digest(df, PATH, ["doc_id"]).collect()}
    assert got == {(1, 0), (None, len(library.encode("two  words").ids)), (2, 0)}
    empty = bpe.digest(df.limit(0), PATH, ["doc_id"])
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    back = bpe.decode(bpe.encode(df, PATH, ["doc_id"]), PATH, ["doc_id"])
    assert sorted(r["decoded"] for r in back.collect()) == ["", "", "", "two  words"]
    assert {r["ids_sha256"] for r in bpe.digest(df.where("text = ''"), PATH, ["doc_id"]).collect()} == {hashlib.sha256(b"").hexdigest()}
