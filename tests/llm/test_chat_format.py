from __future__ import annotations

import hashlib
import random

from glossa.llm import chat_format as cf

PARTS = ["###", "</turn>", "\\", "\n", " ", "a", "### user: ", ":", "</turn>\n", "#", "<", " </turn>\n", "é"]


def test_round_trip():
    rng = random.Random(7)
    for _ in range(20_000):
        turns = [(rng.choice(["user", "assistant", None, "a:b", "x\n### ", "\\=", "", "?", " "]), "".join(rng.choice(PARTS) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(1, 4))]
        assert cf.parse("".join(cf.render_turn(r, t)[0] for r, t in turns)) == turns


def test_plain_text_is_not_escaped():
    assert cf.render_turn("user", "a \\ b #") == ("### user: a \\ b # </turn>\n", 10)
    assert cf.render_turn("user", "\\### x")[0] == "### user: \\\\\\### x </turn>\n"
    assert cf.parse("### user: ### </turn>\n") is None and cf.parse("x") is None


def test_digests(spark):
    told = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", told), (1, 2, "assistant", None), (2, 5, "assistant", "x"), (2, 5, "assistant", "x"), (None, None, None, None), (3, 0, "user", "long " * 30_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r["conv_id"]: r for r in cf.format_digests(df.repartition(3)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha(f"user\nq\nassistant\n{told}\nassistant\n\n") and got[1]["n_turns"] == 3
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(told), sha(told))
    assert got[2]["loss_sha256"] == sha("xx") and got[2]["n_turns"] == 2
    assert got[None]["turns_sha256"] == sha("\n\n") and got[3]["loss_chars"] == 0 and len(got) == 4
    turns = cf.format_turns(df).collect()
    assert sum(len(r["rendered"]) for r in turns if r["conv_id"] == 1) == got[1]["formatted_chars"]
    assert [r["rendered"][r["loss_from"] : r["loss_to"]] for r in turns if r["conv_id"] == 2] == ["x", "x"]
    assert cf.format_digests(df.limit(0)).count() == 0


def test_rows_without_an_id_are_conversations_of_their_own(spark):
    df = spark.createDataFrame([(None, 0, "user", f"t{i}") for i in range(30)] + [(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string").repartition(3)
    rows = cf.format_digests(df).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"]) for r in rows) == [(0, 1)] * 30 + [(1, 2)]


def test_the_parser_reads_a_text_in_any_pieces():
    rng = random.Random(8)
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", None, "a:b"]), "".join(rng.choice(PARTS) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(1, 5))]
        writer = cf.Writer()
        text = "".join(writer.add(r, t)[0] for r, t in turns)
        parser, read, at = cf.Parser(), [], 0
        while at < len(text):
            step = rng.randrange(1, 12)
            read += parser.feed(text[at : at + step])
            at += step
        assert read == turns and not parser.rest
