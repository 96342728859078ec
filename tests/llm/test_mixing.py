from __future__ import annotations

import random

from pyspark.sql import functions as F

from glossa.llm import mixing


def test_apportionment_is_by_highest_quotients():
    rng = random.Random(3)
    for _ in range(200):
        votes = [rng.choice([0, 1, 5.5, rng.random() * 100]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(400)
        most = [rng.choice([10**9, rng.randrange(300)]) for _ in votes]
        want = [0] * len(votes)
        for _ in range(seats):
            open_ = [(-v / (2 * k + 1), i) for i, (v, k, m) in enumerate(zip(votes, want, most, strict=True)) if v > 0 and k < m]
            if not open_:
                break
            want[min(open_)[1]] += 1
        assert mixing.apportion(seats, votes, most) == want


def test_many_sources_are_apportioned_fast():
    rng = random.Random(8)
    votes = [rng.lognormvariate(0, 3) for _ in range(20_000)]
    got = mixing.apportion(10**9, votes, [10**9] * len(votes))
    assert sum(got) == 10**9
    high = max(v / (2 * k + 1) for v, k in zip(votes, got, strict=True))  # the next seat's quotient
    assert all(k == 0 or v / (2 * k - 1) >= high * (1 - 1e-12) for v, k in zip(votes, got, strict=True))
    assert mixing.apportion(7, [1.0] * 20_000, [1] * 20_000) == [1] * 7 + [0] * 19_993


def test_targets_stop_at_the_cap_and_share_the_excess():
    assert mixing.targets([100, 100], [1, 3], 3) == [50.0, 150.0]
    got = mixing.targets([1000, 10, 10], [1, 2, 3], 3)
    assert got == [960.0, 30.0, 30.0]
    assert mixing.targets([0, 5], [1, 2], 3) == [0.0, 5.0] and mixing.targets([], [], 3) == []


def frame(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "b", "b", "b", None, "B"]), 1) for i in range(800)]
    return spark.createDataFrame([*rows, (900, None, "a", 1), (901, "", "zero", 1), (902, " \n", "zero", 1), (None, "x y", "a", 1)], "doc_id long, text string, source string, size int")


def test_mix(spark):
    df = frame(spark)
    rows = mixing.mix(df, ["doc_id", "source"]).collect()
    assert len(rows) == 804
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0], s[1] = s[0] + r["size"], s[1] + r["taken"]
    for size, taken, target, source_size in by.values():
        assert size == source_size and abs(taken - target) <= max(3, 0.02 * target)
    names = sorted(x for x in by if x is not None) + [None]
    want = mixing.targets([by[x][0] for x in names], [(1, 2, 3)[i % 3] for i in range(len(names))], 3)
    assert [by[x][2] for x in names] == want and abs(sum(want) - total) < 1e-6 and by["zero"][1] == 0
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    assert sorted(rows, key=key) == sorted(mixing.mix(df.repartition(7), ["doc_id", "source"]).collect(), key=key)


def test_empty_and_repeated_rows(spark):
    df = frame(spark)
    assert mixing.mix(df.limit(0), ["doc_id"]).count() == 0
    twice = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(twice, ["doc_id"]).collect()] == [3, 3]


def test_taken_words_by_walking_over_the_documents(spark, monkeypatch):
    """Each shard's documents lie in seeded order; its quota is whole passes and a row of blocks from the seeded start."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 40)
    df = frame(spark)
    rows = mixing.mix(df, ["doc_id", "source"], seed=5).collect()
    key = F.concat(F.lit("s"), F.col("source"))
    keyed = df.select("doc_id", "source", F.coalesce(key, F.lit("z")).alias("src"), F.xxhash64(F.lit(5), "doc_id", "source").alias("row"), "text").collect()
    size = {(r["doc_id"], r["source"]): len((r["text"] or "").split()) for r in keyed}
    sources = {}
    for r in keyed:
        sources.setdefault(r["src"], []).append(r)
    goal = {"s" + r["source"] if r["source"] is not None else "z": r["target"] for r in rows}
    names = sorted(sources)
    number = {s: -(-len(sources[s]) // 40) for s in names}
    total = {s: sum(size[r["doc_id"], r["source"]] for r in sources[s]) for s in names}
    block = max(1, min(mixing.BLOCK, int(min(goal[s] / number[s] for s in names if goal[s] > 0) / 100)))
    seats = mixing.apportion(round(sum(total.values()) / block), [goal[s] for s in names], [3 * (total[s] // block + number[s]) for s in names])
    want = {}
    for s, given in zip(names, seats, strict=True):
        hashes = spark.createDataFrame([(r["doc_id"], r["row"]) for r in sources[s]], "doc_id long, row long")
        shard = {r["doc_id"]: r["s"] for r in hashes.select("doc_id", F.pmod(F.xxhash64("row"), F.lit(number[s])).alias("s")).collect()}
        parts = [sorted((r for r in sources[s] if shard[r["doc_id"]] == i), key=lambda r: (r["row"], size[r["doc_id"], r["source"]])) for i in range(number[s])]
        parts = [(i, p) for i, p in enumerate(parts) if p]
        words = [sum(size[r["doc_id"], r["source"]] for r in p) for _, p in parts]
        quota = mixing.apportion(given, [float(w) for w in words], [3 * -(-w // block) for w in words])
        starts = spark.createDataFrame([(s, i) for i, _ in parts], "src string, shard int").select("shard", F.xxhash64(F.lit(5), "src", "shard").alias("x")).collect()
        start = {r["shard"]: r["x"] for r in starts}
        for (i, p), w, q in zip(parts, words, quota, strict=True):
            blocks = -(-w // block)
            times = [0] * blocks
            for k in range(q):
                times[(start[i] + k) % blocks] += 1
            at = 0
            for r in p:
                n = size[r["doc_id"], r["source"]]
                want[r["doc_id"], r["source"]] = sum(times[x // block] for x in range(at, at + n))
                at += n
    assert {(r["doc_id"], r["source"]): r["taken"] for r in rows} == want
    assert max(number.values()) > 5


def test_a_source_with_most_rows_and_a_very_long_text(spark):
    rows = [(i, "w " * (i % 50), "hot") for i in range(6000)] + [(7000, "long " * 300_000, "b"), (7001, "x", "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"]).collect()
    assert len(got) == 6002 and {r["size"] for r in got if r["doc_id"] == 7000} == {300_000}
    for s in ("hot", "b"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.01 * mine[0]["target"]
