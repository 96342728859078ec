from __future__ import annotations

import numpy as np

from glossa.llm import topk_search as ts


def brute(rows, k, every):
    whole = {}
    ok = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            whole[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted((q, *x) for q, xs in whole.items() for x in xs)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ts, "CHUNK", 16)
    monkeypatch.setattr(ts, "QUERY_BLOCK", 4)
    monkeypatch.setattr(ts, "HEAD", 16)
    monkeypatch.setattr(ts, "GROUP", 2)
    rng = np.random.default_rng(10)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.1, 1, 3])).tolist()) for i in range(150)]
    rows += [(200 + i, rows[40][1]) for i in range(30)]  # many ties
    rows += [(400, None), (401, []), (402, [1.0, None, *[0.0] * 10]), (403, [float("nan")] * 12), (404, [float("inf")] * 12), (None, [1.0] * 12), (420, [0.0] * 12), (440, [1.0, 2.0]), (441, [3.0, -1.0]), (460, [1e9] * 12)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = sorted(map(tuple, ts.top_k(df, query_every=10, k=7).collect()))
    assert got == brute(rows, 7, 10)


def test_fewer_vectors_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [-1.0, 2.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, ts.top_k(df).collect())) == [(0, 1, 1, -64 * 64 + 32 * 128)]
    assert ts.top_k(df.limit(0)).count() == 0


def test_one_vector_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ts, "CHUNK", 32)
    monkeypatch.setattr(ts, "HEAD", 64)
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(1001 + i, rows[7][1]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted(map(tuple, ts.top_k(df).collect())) == brute(rows, 20, 20)


def test_what_a_chunk_tells_doesnt_grow_with_copies():
    rng = np.random.default_rng(12)
    one = rng.integers(-50, 50, 8)
    chunk = ts._Chunk(np.arange(100, 600), np.tile(one, (500, 1)), np.eye(8))
    asked = ts._Chunk(np.array([5]), one[None, :], np.eye(8), ordered=False)
    score = int(one @ one)
    got = ts.search(asked, chunk, np.array([score]), np.array([99]), 20)
    assert len(got[0]) == 0
    got = ts.search(asked, chunk, np.array([score]), np.array([104]), 20)
    assert got[1].tolist() == [100, 101, 102, 103, 104]


def test_wide_numbers(spark):
    held = lambda x: max(min(int(np.floor(64 * x)) if abs(x) < 1e300 else int(np.sign(x)) << 62, 1 << 62), -(1 << 62))
    rows = [(i, [float(10.0 ** (i % 25)), float(-(3.0 ** (i % 41))), 1e308 if i == 33 else 1.5]) for i in range(60)]
    whole = {i: [held(x) for x in v] for i, v in rows}
    want = []
    for q in (0, 20, 40):
        scores = sorted((-max(min(sum(a * b for a, b in zip(whole[q], w, strict=True)), 2**63 - 1), -(2**63)), i) for i, w in whole.items() if i != q)[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ts.top_k(df).collect())) == sorted(want)
