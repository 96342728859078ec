from __future__ import annotations

import random
import re

import pytest

from glossa.llm import components as cc
from glossa.llm import jaccard_join as jj


def shingles(text, n):
    t = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    """Rows are documents of their own, whatever their ids."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(sets)
    for a, (_, s) in enumerate(sets):
        for b, (_, t) in enumerate(sets):
            if a != b and s and t and 100 * len(s & t) >= percent * len(s | t):
                links[a] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)], links[k]) for k, (i, s) in enumerate(sets))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 12, 30, 60, 120]))] + (passage if rng.random() < 0.4 else [])
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rows += [None, "", "  ", "one", "ONE", "É a b c", "é a b c"]
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "small"), [(4, 85, False), (5, 80, True)])
def test_against_all_pairs(spark, monkeypatch, n, percent, small):
    if small:  # many blocks
        monkeypatch.setattr(jj, "BLOCK_SETS", 3)
    monkeypatch.setattr(jj, "MIN_COMMON", 3)
    rows = corpus(n)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, k int").repartition(3)
    got = jj.jaccard_join(df, n=n, percent=percent).collect()
    assert sorted(map(tuple, got)) == brute(rows, n, percent)


def test_one_id_with_several_texts(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(60)) for _ in range(4)]
    rows = [(1, base[0]), (1, base[1]), (2, base[0] + " x"), (3, base[1] + " y"), (1, base[0]), (3, base[2]), (7, base[2] + " z"), (7, base[3]), (5, ""), (5, base[3] + " v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jj.jaccard_join(df).collect())) == brute(rows, 4, 85)
    kept = sorted(map(tuple, jj.first_of_each(df).collect()))
    assert kept == sorted([(1, base[0]), (1, base[1]), (3, base[2]), (5, ""), (5, base[3] + " v")])


def test_large_group_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr(cc, "HUB_ROWS", 20)
    monkeypatch.setattr(cc, "HUBS", 4)
    monkeypatch.setattr(jj, "BLOCK_SETS", 64)
    rng = random.Random(6)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 5) for _ in range(80)]
    rows = [(i, " ".join(base)) for i in range(100)] + [(100 + i, " ".join(base[: 80 - i % 3] + [f"own{i}"])) for i in range(200)] + [(300 + i, f"other text {i} " * 5) for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, jj.jaccard_join(df).collect())) == brute(rows, 4, 85)
    assert sorted(r["doc_id"] for r in jj.first_of_each(df, n=4, percent=85).collect()) == [0, *range(300, 350)]


def test_what_verification_moves_follows_the_table(spark, monkeypatch):
    """Texts that have only a passage in common don't meet, and those of a large group meet in several rounds."""
    monkeypatch.setattr(jj, "BLOCK_SETS", 8)
    monkeypatch.setattr(jj, "MIN_COMMON", 3)
    monkeypatch.setattr(jj, "ROUND_TOKENS", 100, raising=False)
    moved, verified = [], jj._verified
    monkeypatch.setattr(jj, "_verified", lambda rows, n, percent: moved.append(rows.count()) or verified(rows, n, percent))
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(100_000)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(60)]
    apart = [(i, " ".join([*(word() for _ in range(25)), *passage])) for i in range(160)]
    alike = [(1000 + i, " ".join([*base, f"own{i}"])) for i in range(80)]
    rows = apart + alike
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jj.jaccard_join(df).collect())) == brute(rows, 4, 85)
    assert max(moved) <= 2 * len(rows)


def test_links_of_a_large_group_follow_its_sets(spark, monkeypatch):
    """Not its equal entries, each of which may have a leader of its own."""
    links, all_of = [], jj.components
    monkeypatch.setattr(jj, "components", lambda rows, a, b: links.append(rows.count()) or all_of(rows, a, b))
    rng = random.Random(8)
    base = [f"w{rng.randrange(100_000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        text = list(base)
        for k in rng.sample(range(120), 3):
            text[k] = f"own{i}x{k}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    assert sorted(map(tuple, jj.jaccard_join(df).collect())) == brute(rows, 4, 85)
    assert links[0] <= 3 * 2 * len(rows)  # a set is in two groups


def test_classes_of_a_large_group_follow_its_sets(spark, monkeypatch):
    """Sets that are known to be of one class don't meet in every pair of blocks."""
    monkeypatch.setattr(jj, "BLOCK_SETS", 16)
    monkeypatch.setattr(jj, "MANY_BLOCKS", 4, raising=False)
    moved, verified = [], jj._verified
    monkeypatch.setattr(jj, "_verified", lambda rows, *a: moved.append(rows.count()) or verified(rows, *a))
    rng = random.Random(12)
    base = [f"w{rng.randrange(100_000)}" for _ in range(120)]
    rows = []
    for i in range(500):
        text = list(base)
        for k in rng.sample(range(120), 1 + 2 * (i % 9 == 0)):  # a few link with few of the others
            text[k] = f"own{i}x{k}"
        rows.append((i, " ".join(text[: 120 - i % 3])))
    rows += [(600 + i, " ".join(f"w{rng.randrange(100_000)}" for _ in range(50))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = sorted(r["doc_id"] for r in jj.first_of_each(df).collect())
    assert kept == sorted({least for _, _, least, _ in brute(rows, 5, 80)})
    assert sum(moved) <= 12 * len(rows), moved


def test_few_sets_are_sent_to_few_buckets(spark, monkeypatch):
    """And their entries meet in so many tasks, whatever the number of partitions."""
    sent, over = [], jj.over_batches
    monkeypatch.setattr(jj, "over_batches", lambda rows, fn, schema: sent.append(over(rows, fn, schema)) or sent[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        rows = [(i, f"some {i} words of a text {i % 7} that is short") for i in range(400)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
        jj.candidate_links(df, "text", 4, 85, 400, 3200, jj.np.zeros(0, dtype=jj.np.uint64)).count()
        assert sent[0].where("first IS NOT NULL").count() <= 2 * 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_very_long_text(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(1000)}x{i % 997}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:])), (3, " ".join(words[:100_000])), (4, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jj.jaccard_join(df).collect())) == brute(rows, 4, 85)


def test_blocks_are_read_as_written():
    import numpy as np

    rng = np.random.default_rng(5)
    for bits in (40, 50, 64):
        for n in (1, 2, 700):
            sig = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(64 - bits))
            node = rng.integers(0, 1 << 40, len(sig), dtype=np.uint64)
            bucket = (sig >> np.uint64(bits - 32)) * np.uint64(1000) >> np.uint64(32)
            rows = jj._blocks(sig, node, bucket, 5).to_pylist()
            back = [jj._read(r["first"], r["steps"], r["nodes"], 5) for r in rows]
            assert np.array_equal(np.concatenate([x for x, _ in back]), sig) and np.array_equal(np.concatenate([x for _, x in back]), node)


def test_linked_sets_share_an_entry():
    import numpy as np

    rng = np.random.default_rng(8)
    for percent in (80, 85):
        for size in (1, 2, 5, 7, 9, 13, 20, 50, 200):
            for _ in range(40):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                drop = int(rng.integers(0, len(a)))
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 3 + drop)), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                common = np.sort(rng.permutation(np.union1d(a, b))[: int(rng.integers(0, 2 * size))])
                if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                    continue
                bands = [int(np.searchsorted(jj.bands(percent), len(x))) for x in (a, b)]
                assert abs(bands[0] - bands[1]) <= 1
                groups = {bands[0], bands[0] + 1} & {bands[1], bands[1] + 1}
                assert max(bands) in groups
                g = max(bands)
                assert len(np.intersect1d(jj.entries(a, g, percent, common), jj.entries(b, g, percent, common)))


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, jj.jaccard_join(df).collect()), key=repr) == [(1, 2, 1, 1), (1, 2, 1, 1), (None, 2, None, 0)]
    assert jj.jaccard_join(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == want


def test_finished_components_leave(spark, monkeypatch):
    """A long chain costs rounds for its own links, not for those of all the others."""
    joined, attached = [], cc.attached
    monkeypatch.setattr(cc, "attached", lambda rows, each, key, total: joined.append(rows.count()) or attached(rows, each, key, total))
    edges = [(4 * i, 4 * i + k) for i in range(1000) for k in (1, 2, 3)] + [(10_000 + i, 10_001 + i) for i in range(200)]
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: 10_000 if n >= 10_000 else n // 4 * 4 for e in edges for n in e}
    assert len(joined) > 8 and sum(joined) <= 4 * len(edges)
