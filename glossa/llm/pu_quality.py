"""Quality classifier learned from positives and unlabelled text.

Method: positive-unlabelled learning with the non-negative unbiased risk. With trusted positives P, unlabelled web
text U and the class prior p, the risk is p R_P(+1) + max(0, R_U(-1) - p R_P(-1)) under the logistic loss; where the
second part falls below zero, a step goes the other way, so that the model can't drive it down by overfitting. The
prior is the share of label 1 among all labelled training rows. The model is linear: in shares and counts of the whole
text (letter classes, marks, repetition, lengths) and their squares, and in the hashed frequencies of its words and of
its byte trigrams.

Bounds: the fit takes about fit_positives and fit_unlabelled rows, chosen by a hash of the row's id, however large the
tables; the prior is counted over all labelled rows, and every row is scored.

Defined results: a null or empty text has features of its own and gets a score like any other; a text of any length
is read whole, in one row's memory; without positives the score is 0.5 everywhere, without training rows too; of
several labels for one id the highest counts; a score of exactly 0.5 predicts 1; repeated rows each count; empty
tables of documents give empty results; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import over_batches, slices

FIT_POSITIVES, FIT_UNLABELLED = 10_000, 20_000
STEPS, RATE, DECAY = 600, 0.05, 1e-4
#: Hashed frequencies of words and of byte trigrams.
WORD_SLOTS, TRIGRAM_SLOTS = 128, 128
#: A slot's spread counts as this at least, so that rare words don't outweigh the rest.
SLOT_SPREAD = 0.1
_MARKS = b"#*$%&|<>!?.,;:'\"()[]{}-_=+/\\@~^`"


def _lexical(raw: np.ndarray, counts: Counter, words: int) -> np.ndarray:
    """Roots of the hashed frequencies of words and of byte trigrams."""
    slots = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % WORD_SLOTS for w in counts), dtype=np.int64, count=len(counts))
    of_words = np.bincount(slots, weights=np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), minlength=WORD_SLOTS)
    x = raw.astype(np.uint32)
    grams = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 7)
    of_grams = np.bincount(grams, minlength=TRIGRAM_SLOTS)
    return np.sqrt(np.concatenate([of_words / max(words, 1), of_grams / max(len(grams), 1)]))


def features(text: str | None) -> np.ndarray:
    """Shares of letter classes and marks, word and line repetition, lengths (DENSE of them); hashed words and trigrams."""
    t = text or ""
    raw = np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8)
    h = np.bincount(raw, minlength=256)
    n = max(len(raw), 1)
    upper, lower, digits = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum())
    words = t.split()
    m = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in t.split("\n") if x]
    top = max(counts.values(), default=0)
    twice = sum([a == b for a, b in zip(words, words[1:], strict=False)])
    out = [
        upper / max(upper + lower, 1), digits / n, int(h[128:].sum()) / n, (upper + lower) / n,
        len(counts) / m, top / m, twice / m, np.log1p(len(words)) / 8, n / m / 10, len(lines) / m,
        1 - len(set(lines)) / max(len(lines), 1), np.log1p(n) / 10, float(not words),
    ]
    marks = h[np.frombuffer(_MARKS, dtype=np.uint8)] / m
    return np.concatenate([out, np.log1p(20 * marks), [np.log1p(20 * marks.sum())], _lexical(raw, counts, m)]).astype(np.float32)


WIDTH = len(features(""))
DENSE = WIDTH - WORD_SLOTS - TRIGRAM_SLOTS


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z[:, :DENSE] ** 2 - 1, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigma(self.design(x) @ self.weights)


def _sigma(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the risk, p R_P(+1) and R_U(-1) - p R_P(-1), and their gradients."""
    sp, su = _sigma(xp @ w), _sigma(xu @ w)
    off = lambda s: -np.log1p(-np.minimum(s, 1 - 1e-12)).mean()  # noqa: E731  the loss of taking a score for label -1
    as_positive = -prior * np.log(np.maximum(sp, 1e-12)).mean()
    return as_positive, off(su) - prior * off(sp), -prior * (xp.T @ (1 - sp)) / len(xp), xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative risk by full gradient steps (Adam); the same rows give the same model."""
    both = np.vstack([positives, unlabelled]).astype(np.float64)
    spread = both.std(axis=0) if len(both) else np.ones(both.shape[1])
    model = Model(np.zeros(both.shape[1] + DENSE + 1), both.mean(axis=0) if len(both) else np.zeros(both.shape[1]), np.maximum(spread, np.where(np.arange(both.shape[1]) < DENSE, 1e-3, SLOT_SPREAD)))
    if not len(positives) or not len(unlabelled):
        return model
    xp, xu = model.design(both[: len(positives)]), model.design(both[len(positives) :])
    w, m, v = model.weights, np.zeros_like(model.weights), np.zeros_like(model.weights)
    for k in range(1, STEPS + 1):
        _, second, good, bad = risk(w, xp, xu, prior)
        g = (good + bad if second >= 0 else -bad) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return model


def _sample(df: DataFrame, row_id: Column, n: int, rows: int) -> DataFrame:
    """About n of df's rows, by a hash of row_id."""
    share = min(1.0, n / max(rows, 1))
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(row_id), F.lit(1 << 30)) < int(share * (1 << 30)))


def _features(texts: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in texts.to_pylist()], dtype=np.float32).reshape(len(texts), WIDTH)


def _matrix(df: DataFrame, text: str) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x"):
                rows = [x.tobytes() for x in _features(part.column("x"))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["f"])

    rows = over_batches(df.select(F.col(text).alias("x")), run, "f binary").toArrow().column("f").to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float32).reshape(len(rows), WIDTH)


def train(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "quality", fit_positives: int = FIT_POSITIVES, fit_unlabelled: int = FIT_UNLABELLED) -> tuple[Model, float]:
    """A model from docs (training rows only) and labels (one row per labelled id), and the prior."""
    marked = labels.where(F.col(label).isNotNull()).groupBy(F.col(row_id).alias("id_")).agg(F.max(label).alias("mark_"))
    known = docs.select(F.col(row_id).alias("id_")).join(marked, "id_").agg(F.count("*"), F.coalesce(F.sum((F.col("mark_") == 1).cast("long")), F.lit(0))).head()
    rows, trusted = docs.count(), known[1]
    prior = min(max(trusted / known[0], 0.01), 0.99) if known[0] else 0.5
    trusted_ids = _sample(marked.where("mark_ = 1"), F.col("id_"), fit_positives, trusted)
    positives = docs.join(trusted_ids, F.col(row_id) == F.col("id_"), "left_semi")
    if fit_positives < trusted:
        positives = _sample(positives, F.col(row_id), fit_positives, trusted)
    return fit(_matrix(positives, text), _matrix(_sample(docs, F.col(row_id), fit_unlabelled, rows), text), prior), prior


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep of docs, score and predicted."""
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    frame = docs.select(*own, F.col(text).alias("x_"))
    kinds = "".join(f"k{i} {frame.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.concatenate([model.score(_features(part.column("x_"))) for part in slices(batch, "x_")] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*(f"k{i}" for i in range(len(keep))), "score", "predicted"])

    return over_batches(frame, run, f"{kinds}score double, predicted int").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
