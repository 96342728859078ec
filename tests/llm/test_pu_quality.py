from __future__ import annotations

import random

import numpy as np

from glossa.llm import pu_quality as pu


def docs(spark, n=600):
    rng = random.Random(11)
    good = lambda: " ".join(rng.choice(["plain", "words", "make", "a", "clean", "text", "here."]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["NOISE!!", "$$$", "###", "BUY"]) for _ in range(40))
    rows = [(i, good() if i % 5 else bad(), 1 if i % 5 else 0) for i in range(n)]
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(10_000, None, "x"), (10_001, "", "x"), (None, "plain words", "x"), (10_002, "text " * 50_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2 == 0] + [(5, None)], "doc_id long, quality int")
    return d, labels, {i: q for i, _, q in rows}


def test_learns_from_positives_and_unlabelled(spark):
    d, labels, truth = docs(spark)
    model, prior = pu.train(d, labels)
    assert abs(prior - 0.8) < 0.02
    rows = pu.score(d, model, ["doc_id"]).collect()
    assert len(rows) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows if r["doc_id"] in truth]) > 0.98
    again, _ = pu.train(d.repartition(3), labels, fit_positives=60, fit_unlabelled=120)
    held = pu.score(d, again, ["doc_id"]).collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]) > 0.95


def test_without_labels(spark):
    d, labels, _ = docs(spark, 20)
    model, prior = pu.train(d, labels.limit(0))
    assert prior == 0.5 and {r["score"] for r in pu.score(d, model, ["doc_id"]).collect()} == {0.5}
    assert pu.score(d.limit(0), model, ["doc_id"]).count() == 0


def test_risk_and_gradient_by_hand():
    rng = np.random.default_rng(13)
    xp, xu, w, prior = rng.normal(size=(7, 4)), rng.normal(size=(11, 4)), rng.normal(size=4), 0.3
    loss = lambda margin: np.log(1 + np.exp(-margin))
    first = lambda w: prior * np.mean([loss(x @ w) for x in xp])
    second = lambda w: np.mean([loss(-(x @ w)) for x in xu]) - prior * np.mean([loss(-(x @ w)) for x in xp])
    got = pu.risk(w, xp, xu, prior)
    assert np.allclose(got[:2], (first(w), second(w)))
    for f, g in ((first, got[2]), (second, got[3])):
        slope = [(f(w + h) - f(w - h)) / 2e-6 for h in np.eye(4) * 1e-6]
        assert np.allclose(slope, g, atol=1e-6)


def test_the_fit_lowers_the_risk_and_stays_above_zero():
    rng = np.random.default_rng(14)
    positives = rng.normal(size=(200, pu.WIDTH)).astype(np.float32) + 1
    negatives = rng.normal(size=(200, pu.WIDTH)).astype(np.float32) - 1
    unlabelled = np.vstack([positives[:100], negatives[:100]])
    model = pu.fit(positives, unlabelled, 0.5)
    xp, xu = model.design(positives), model.design(unlabelled)
    total = lambda w: (lambda a, b: a + max(b, 0))(*pu.risk(w, xp, xu, 0.5)[:2])
    assert total(model.weights) < 0.5 * total(np.zeros_like(model.weights))
    assert model.score(positives[100:]).mean() > 0.9 and model.score(negatives[100:]).mean() < 0.1


def test_words_alone_tell(spark):
    """The same letters, marks and lengths; only the words differ."""
    rng = random.Random(15)
    make = lambda kind: " ".join("".join(rng.sample(w, 3)) if kind else w for w in [rng.choice(["abc", "bcd", "cde", "dea"]) for _ in range(60)])
    rows = [(i, make(i % 2), i % 2) for i in range(800)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4 < 2 and i < 600], "doc_id long, quality int")
    model, _ = pu.train(d.where("doc_id < 600"), labels)
    got = {r["doc_id"]: r["predicted"] for r in pu.score(d, model, ["doc_id"]).collect()}
    assert np.mean([got[i] == y for i, _, y in rows if i >= 600]) > 0.95


def test_repeated_rows(spark):
    d, labels, _ = docs(spark, 100)
    model, _ = pu.train(d.unionByName(d), labels.unionByName(labels))
    rows = pu.score(d.unionByName(d), model, ["doc_id"]).collect()
    assert len(rows) == 2 * d.count() and len({(r["doc_id"], r["score"]) for r in rows}) == d.count()
