from __future__ import annotations

import random
import re

from glossa.llm import quality_rules as qr


def brute(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_rules(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b", " ", " ", "\n", "\x0b", "é", "#", "\U0001f600", "|", "a b "]) for _ in range(rng.randrange(150))) for _ in range(150)]
    texts += [None, "", " ", "x " * 3000, "a b c d e f g h " * 2, "\n\n"]
    df = spark.createDataFrame([(i, t, "s", "q") for i, t in enumerate(texts)], "doc_id long, text string, source string, kept string")
    rows = qr.apply_rules(df, keep=["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(200)] + [(i, bad if i % 10 else good, "rotten") for i in range(200, 400)] + [(400, good, None), (401, bad, None), (402, good, "single")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in qr.apply_rules(df, keep=["doc_id"]).where("kept").collect()}
    assert kept == {i for i in range(200) if i % 10} | {400, 402}  # the rotten host's good pages go with it; one bad page damns no host


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", "s"), (1, "a", "s")], "doc_id long, text string, source string")
    assert qr.apply_rules(df, keep=["doc_id"]).count() == 2
    assert qr.apply_rules(df.limit(0), keep=["doc_id"]).count() == 0
