"""The stages in their order on the smallest tables and on awkward rows."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glossa.llm import mixing
from tests.llm import test_jaccard_join, test_language_id, test_quality_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_narrow_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        ids = {r[0] for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert {r[0] for r in docs.select("doc_id").collect()} <= ids and docs.count() > 100
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and "ids_sha256" in last.columns


def test_awkward_rows(spark):
    good = lambda k: " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[(i * k) % 10]} the" for i in range(30))
    rows = [(1, good(1), "en", "s", 1, "x"), (2, good(1) + " more", "en", "s", 1, "x"), (3, good(3), "en", None, 1, "x"), (4, None, None, None, None, "x"), (5, "", "en", "s", 1, "x"), (None, good(7), "en", "s", 1, "x"), (6, "12 " * 40, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert {r["doc_id"] for r in docs.collect()} <= {1, 3, None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_mixed_words_meet_each_sources_target(spark):
    draw = random.Random(5)
    rows = [(f"s{s:02}", " ".join(["w"] * max(1, round(draw.lognormvariate(4, 1))))) for s in range(12) for _ in range((10, 50, 200)[s // 3 % 3])]
    rows = [(i, f"{text} {i}", "en", source, 1) for i, (source, text) in enumerate(rows)]
    rows += [(None, "equal words of rows without ids", "en", "twins", 1)] * 30 + [(None, "other words", "en", None, 1)] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    target = {r["source"]: r["target"] for r in mixing.mix(docs, keep=["source"]).select("source", "target").distinct().collect()}
    largest, words = Counter(), Counter()
    for _, text, _, source, _ in rows:
        largest[source] = max(largest[source], len(text.split()))
    out = corpus_pipeline.mixing_stage(spark, docs, "").collect()
    assert {tuple(r) for r in out} <= set(rows)
    for r in out:
        words[r["source"]] += len(r["text"].split())
    assert len(target) == 14
    off = {s: (words[s], t) for s, t in target.items() if abs(words[s] - t) > largest[s] / 2 + 2}
    assert not off


def awkward(spark):
    """Hosts of all kinds, copies, near copies, repeated rows, one id with several texts, rows without an id, a very long text, texts of no language."""
    rng = random.Random(31)
    words = {"aa": ["thing", "with", "and", "the", "other", "under"], "bb": ["que", "\u00e9t\u00e9", "leur", "nous", "dans", "avec"], "cc": ["nicht", "\u00fcber", "und", "schon", "werden", "haben"]}
    make = lambda g, n: " ".join(rng.choice(words[g]) + rng.choice(["", "", f"{rng.choice('xyzuvw')}{rng.choice('abcde')}"]) for _ in range(n))
    rows = []
    for i in range(160):
        g = rng.choice(list(words))
        rows.append((i, make(g, rng.choice([5, 30, 60, 90])) if i % 9 else "short", g, f"s{i % 7}", i, "x"))
    rows += [(200 + i, "bad text", "aa", "rotten", 1, "x") for i in range(60)] + [(300, make("aa", 50), "aa", "rotten", 1, "x")]
    base = [r for r in rows if len(r[1].split()) >= 60][:12]
    rows += [(400 + i, r[1] + " more", r[2], r[3], 2, "y") for i, r in enumerate(base)] + [(500 + i, r[1], r[2], "s1", 2, "y") for i, r in enumerate(base)]
    rows += [base[0]] * 3 + [(base[1][0], make("bb", 70), "bb", "s2", 3, "z"), (None, make("cc", 40), "cc", None, 1, "x"), (600, None, None, None, None, None), (601, "12 " * 40, "aa", "s3", 1, "x")]
    rows += [(700, make("aa", 60_000), "aa", "s4", 1, "x"), (701, make("bb", 40), None, None, 1, "x")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)


def test_every_stage_against_plain_python(spark):
    rows, docs = awkward(spark)
    seen = lambda df: Counter(map(tuple, df.collect()))

    # quality rules: base rules, then hosts under the beta prior
    base = {r: not test_quality_rules.brute(r[1] if r[1] is None or len(r[1]) < 10**5 else " ".join(f"w{i}" for i in range(99)))[5] for r in set(rows)}
    hosts = {}
    for r in rows:
        if r[3] is not None:
            n, bad = hosts.get(r[3], (0, 0))
            hosts[r[3]] = n + 1, bad + (not base[r])
    n, bad = sum(a for a, _ in hosts.values()), sum(b for _, b in hosts.values())
    mean = bad / n
    between = sum(a * (b / a) ** 2 for a, b in hosts.values()) / n - mean * mean
    strength = min(max(mean * (1 - mean) / max(between - mean * (1 - mean) * len(hosts) / n, 1e-9) - 1, 2), 1000)
    fine = {h for h, (a, b) in hosts.items() if (b + strength * mean) / (a + strength) <= 0.6}
    want = [r for r in rows if base[r] and (r[3] is None or r[3] in fine)]
    got = corpus_pipeline.quality_stage(spark, docs, "")
    assert seen(got) == Counter(want) and len(want) < len(rows) - 60

    # language: profiles of those not held out
    learn = [(r[1], r[2]) for r in want if r[2] is not None and (r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 != 1)]
    short = lambda t: t[:3000]  # noqa: E731  the reference here is slow; a long text of one language has the same nearest profile
    said = test_language_id.by_hand([(short(t), g) for t, g in learn], [short(r[1]) for r in want])
    want = [r for r, (lang, score) in zip(want, said, strict=True) if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    docs = spark.createDataFrame(got.collect(), got.schema).repartition(3)
    got = corpus_pipeline.language_stage(spark, docs, "")
    assert seen(got) == Counter(want)

    # near duplicates: of each class the smallest id, once; rows without an id stay
    named = [r for r in want if r[0] is not None]
    sets = [test_jaccard_join.shingles(r[1], 5) for r in named]
    group = list(range(len(named)))
    for a in range(len(named)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [min(group[a], group[b]) if x in (group[a], group[b]) else x for x in group]
    classes = {}
    for r, g in zip(named, group, strict=True):
        classes.setdefault(g, []).append(r)
    docs = spark.createDataFrame(got.collect(), got.schema).repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    kept = got.collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([min(r[0] for r in c) for c in classes.values()] + [None] * (len(want) - len(named)))
    assert {tuple(r) for r in kept} <= set(want) and len({r["text"] for r in kept}) == len(kept) < len(want) - 12
    assert all(sum(r["text"] == x[1] for x in c for r in kept) <= len(c) for c in classes.values())

    # mixing: whole documents, three times at most, each source's words near its target
    docs = spark.createDataFrame(kept, got.schema).repartition(3)
    target = {r["source"]: r["target"] for r in mixing.mix(docs, keep=["source"]).select("source", "target").distinct().collect()}
    got = corpus_pipeline.mixing_stage(spark, docs, "")
    copies = seen(got)
    assert set(copies) <= {tuple(r) for r in kept} and max(copies.values()) <= 3
    for source, goal in target.items():
        sizes = [len(r["text"].split()) for r in kept if r["source"] == source]
        assert abs(sum(n * len(r[1].split()) for r, n in copies.items() if r[3] == source) - goal) <= max(sizes) / 2 + 2

    # encoding: the library's ids
    last = corpus_pipeline.encoding_stage(spark, got, "").collect()
    library = Tokenizer.from_file(corpus_pipeline.BYTE_BPE)
    ids = {t: b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in {r[1] for r in copies}}
    want = Counter((r[0], len(ids[r[1]]) // 4, hashlib.sha256(ids[r[1]]).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()) for r in copies.elements())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in last) == want
