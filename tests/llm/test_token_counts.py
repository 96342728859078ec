from __future__ import annotations

import random

import public_tokenizers as P
import pytest
import sentencepiece

from glossa.llm import token_counts

PATH = P.path("piece_bpe_32k.model")
ALPHABET = "ab 's'll\n\t \r  .é漢字\U0001f60012²½_\x1c\x85\xa0▁    AAAA<s></s><unk>"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n=3000):
    rng = random.Random(2)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(50))) for _ in range(n)]
    return made + ["", "<s>", "<0x41>", "a" * 1000, "\0", "=====-----" * 40, "the" * 50] + [" " * k + x for k in range(40) for x in ("", "x", "the ")]


def test_counts_are_the_librarys(library):
    xs = texts()
    assert token_counts.counter(PATH).counts(xs) == [len(x) for x in library.encode(xs)]


def test_every_prefix_has_its_exact_count(library):
    for x in texts(60)[:80]:
        assert token_counts.counter(PATH).prefix_counts(x) == [len(library.encode(x[:i])) for i in range(len(x) + 1)]


def test_the_budget_is_used_up(library):
    c = token_counts.counter(PATH)
    for x in texts(60):
        n = c.fit(x, 7)
        assert len(library.encode(x[:n])) <= 7
        assert all(len(library.encode(x[:i])) > 7 for i in range(n + 1, len(x) + 1))


def test_a_full_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 20)
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 50)
    c = token_counts.Counter(PATH)
    xs = texts(100)
    assert [c.counts([x])[0] for x in xs] == token_counts.counter(PATH).counts(xs)


def test_long_runs_without_blanks(library, monkeypatch):
    rng = random.Random(4)
    c = token_counts.counter(PATH)
    monkeypatch.setattr(token_counts, "WINDOW_CHARS", 37)
    xs = ["".join(rng.choice("漢字thein你好ing世界的一是=-\U0001f600é") for _ in range(rng.randrange(257, 2000))) for _ in range(20)] + ["=" * 900, "the" * 400 + " " * 300 + "x"]
    assert c.counts(xs) == [len(x) for x in library.encode(xs)]
    assert c.prefix_counts(xs[0])[-30:] == [len(library.encode(xs[0][:i])) for i in range(len(xs[0]) - 29, len(xs[0]) + 1)]


def test_a_megabyte_without_blanks(library):
    rng = random.Random(5)
    text = "".join(chr(0x4E00 + int(rng.random() ** 3 * 3000)) for _ in range(350_000))
    assert token_counts.counter(PATH).counts([text]) == [len(library.encode(text))]


def test_frames(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 5), (2, "", 5)], "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.token_counts(df, PATH, ["doc_id"]).collect())
    assert got == [(0, 2), (1, 0), (1, 0), (2, 0)]
    assert token_counts.token_counts(df.limit(0), PATH, ["doc_id"]).count() == 0
    assert {r["n_fit"] for r in token_counts.fit_to_budget(df, PATH, 1, ["doc_id"]).collect()} == {0, 1}
