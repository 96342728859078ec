from __future__ import annotations

import random

import numpy as np
import pytest

from glossa.llm import language_id as lid

WORDS = {"aa": ["thing", "with", "and", "the", "other"], "bb": ["que", "été", "leur", "nous", "dans"], "cc": ["nicht", "über", "und", "schon", "werden"]}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS[g]) for _ in range(12)), g, "x") for i in range(240) for g in [rng.choice([*WORDS])]]
    return spark.createDataFrame([*rows, (1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "12 !!", "aa", "x"), (1003, "thing with", None, "x"), (None, "NICHT ÜBER", None, "x"), (1004, "und " * 30000, None, "x")], "doc_id long, text string, lang string, score string")


def test_profiles(spark, docs):
    bundles = lid.train(docs.where(~lid.held_out()))
    rows = lid.predict(docs, bundles, ["doc_id", "lang"]).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 246
    assert all(r["lang_pred"] == r["lang"] for r in rows if r["lang"] and r["doc_id"] < 1000)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "aa" and got[None]["lang_pred"] == "cc" and got[1004]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in rows)
    again = lid.train(docs.where(~lid.held_out()).repartition(5))
    assert again == bundles


def test_bundles_are_sums_of_bound_letters():
    e = lid.Encoder(64)
    keys, counts = e.grams("Ab ab")
    assert counts.sum() == 5 and len(keys) == 3  # " ab" and "ab " twice, "b a" once
    border, a, b = e.letter(0), e.letter(ord("a")), e.letter(ord("b"))
    bind = lambda x, y, z: np.roll(x, 2).astype(int) * np.roll(y, 1) * z
    want = 2 * bind(border, a, b) + 2 * bind(a, b, border) + bind(b, border, a)
    assert (e.bundle(keys, counts) == want).all()


def test_without_training_rows(spark, docs):
    assert lid.train(docs.limit(0)) == {}
    assert {r["lang_pred"] for r in lid.predict(docs, {}, ["doc_id"]).collect()} == {"und"}


def test_a_small_table_of_vectors_changes_nothing(monkeypatch):
    large = lid.Encoder(64)
    monkeypatch.setattr(lid, "KEPT", 10)
    small = lid.Encoder(64)
    for t in ("the quick brown fox", "jumps over", "the lazy dog and more letters here"):
        assert (small.bundle(*small.grams(t)) == large.bundle(*large.grams(t))).all()


def by_hand(train, texts):
    """Letter by letter: random letter vectors, rotated and bound into trigrams, bundled; the nearest of the centred prototypes."""
    letter = lambda c: np.random.default_rng([lid.SEED, ord(c)]).integers(0, 2, lid.DIM, dtype=np.int8).astype(int) * 2 - 1

    def bundle(text):
        total, words, word = np.zeros(lid.DIM), [], ""
        for c in text + " ":
            if c.isalpha():
                word += c.lower()[0]
            elif word:
                words.append(word)
                word = ""
        line = "\0" + "\0".join(words) + "\0" if words else ""
        for x, y, z in zip(line, line[1:], line[2:]):
            total += np.roll(letter(x), 2) * np.roll(letter(y), 1) * letter(z)
        return total

    langs = sorted({g for _, g in train})
    proto = np.array([sum(bundle(t) for t, g in train if g == lang) for lang in langs])
    proto = proto / np.linalg.norm(proto, axis=1, keepdims=True)
    proto = proto - proto.mean(axis=0)
    proto = proto / np.linalg.norm(proto, axis=1, keepdims=True)
    out = []
    for t in texts:
        v = bundle(t or "")
        if not any(c.isalpha() for c in t or ""):
            out.append((lid.UNKNOWN, 0.0))
            continue
        cos = proto @ v / np.linalg.norm(v)
        out.append((langs[int(np.argmax(cos))], 1 / sum(np.exp(lid.SHARPNESS * (c - cos.max())) for c in cos)))
    return out


def test_against_the_definition(spark):
    rng = random.Random(21)
    words = {"aa": ["the", "Thing", "and", "of"], "bb": ["der", "die", "Größe", "und"], "cc": ["que", "été", "la", "où"]}
    make = lambda g: " ".join(rng.choice(words[g]) for _ in range(rng.randrange(1, 9))) + rng.choice(["", " 12!", "\n"])
    train = [(make(g), g) for g in words for _ in range(6)]
    texts = [make(rng.choice(list(words))) for _ in range(25)] + [None, "", "123", "x", "Zz zz"] + [train[0][0]] * 3
    bundles = lid.train(spark.createDataFrame(train, "text string, lang string"))
    got = {r["i"]: (r["lang_pred"], r["score"]) for r in lid.predict(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), bundles, ["i"]).collect()}
    for i, (lang, score) in enumerate(by_hand(train, texts)):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6


def test_repeated_rows_and_a_language_with_most_rows(spark):
    rows = [("the thing and of", "aa")] * 500 + [("der die und", "bb")] * 3
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    bundles = lid.train(df)
    once = lid.train(df.distinct())
    assert [500 * x for x in once["aa"]] == bundles["aa"] and [3 * x for x in once["bb"]] == bundles["bb"]
    got = lid.predict(df, bundles, ["lang"]).collect()
    assert len(got) == 503 and all(r["lang_pred"] == r["lang"] for r in got) and len({(r["lang"], r["score"]) for r in got}) == 2
