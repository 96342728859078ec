"""Language identification by hyperdimensional profiles.

Method: each letter has a random vector of +1 and -1, made from its code point alone. A trigram is the product (bind)
of its letters' vectors, the first rolled (permuted) by two places, the second by one. A text is the sum (bundle) of
its trigrams' vectors; a language's prototype is the sum over its training texts, taken relative to the mean of all
prototypes. A text gets the language whose prototype has the highest cosine with it.

Sums are of whole numbers, so results don't depend on partitions or order. Training moves one vector per language
and partition, added up by a partial aggregation; one row per language comes to the driver.

Defined results: `und` and score 0 where text is null or has no letter; upper and lower case are one; every other
character is a border between words; a text of any length counts whole; of equal cosines the first language in code
point order wins; without training rows every language is `und`; repeated rows each count; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import over_batches, slices

DIM = 1024
SEED = 7
UNKNOWN = "und"
#: Turns differences of cosines into a score.
SHARPNESS = 40.0
#: Trigram vectors that a worker keeps, and those that are added up at once.
KEPT, ROWS = 30_000, 4_000
_BITS = 21


class Encoder:
    """Trigrams of texts and their vectors."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((KEPT, dim), dtype=np.int8)
        #: For each code point its lower-case letter, 0 for none.
        self.lower = np.zeros(0x110000, dtype=np.int32)
        self.asked = np.zeros(0x110000, dtype=bool)

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            self.letters[cp] = np.random.default_rng([SEED, cp]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
        return self.letters[cp]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct trigrams of text, as numbers, and how often each occurs. Words have a border (0) on both sides."""
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not self.asked[cps].all():
            for cp in np.unique(cps[~self.asked[cps]]).tolist():
                c = chr(cp)
                self.lower[cp] = ord(c.lower()[0]) if c.isalpha() else 0
                self.asked[cp] = True
        a = np.concatenate([[0], self.lower[cps], [0]]).astype(np.int64)
        a = a[np.concatenate([[True], (a[1:] > 0) | (a[:-1] > 0)])]  # one border between words
        if len(a) < 3:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        keys = np.sort((a[:-2] << 2 * _BITS) | (a[1:-1] << _BITS) | a[2:])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.diff(np.append(first, len(keys)))

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Where the vectors of the trigrams stand in self.vectors."""
        row = self.row
        new = [k for k in keys.tolist() if k not in row]
        if len(row) + len(new) > len(self.vectors):
            row.clear()
            new = keys.tolist()
            if len(new) > len(self.vectors):
                self.vectors = np.zeros((2 * len(new), self.dim), dtype=np.int8)
        for k in new:
            x, y, z = k >> 2 * _BITS, (k >> _BITS) & ((1 << _BITS) - 1), k & ((1 << _BITS) - 1)
            self.vectors[len(row)] = np.roll(self.letter(x), 2) * np.roll(self.letter(y), 1) * self.letter(z)
            row[k] = len(row)
        return np.fromiter(map(row.__getitem__, keys.tolist()), dtype=np.int64, count=len(keys))

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors (whole numbers, exact in doubles)."""
        out = np.zeros(self.dim)
        kind = np.float32 if counts.sum() < 1 << 24 else np.float64  # either is exact
        for i in range(0, len(keys), ROWS):
            part = slice(i, i + ROWS)
            rows = self.rows(keys[part])  # may make the table anew
            out += counts[part].astype(kind) @ self.vectors[rows].astype(kind)
        return out


_encoder: list[Encoder] = []


def encoder() -> Encoder:
    if not _encoder:
        _encoder.append(Encoder())
    return _encoder[0]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """The bundle of each language over all rows of docs that have text and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = encoder(), {}
        for batch in batches:
            for part in slices(batch, "x"):
                found: dict[str, list] = {}
                for t, g in zip(part.column("x").to_pylist(), part.column("g").to_pylist(), strict=True):
                    found.setdefault(g, []).append(enc.grams(t))
                for g, each in found.items():
                    keys = np.concatenate([k for k, _ in each])
                    distinct, back = np.unique(keys, return_inverse=True)
                    counts = np.bincount(back, weights=np.concatenate([c for _, c in each]), minlength=len(distinct))
                    total[g] = total.get(g, 0) + enc.bundle(distinct, counts)
        for g, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(v)), pa.array(np.arange(len(v)), pa.int32()), pa.array(v.astype(np.int64))], names=["g", "i", "v"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("x"), F.col(lang).alias("g"))
    sums = over_batches(rows, run, "g string, i int, v long").groupBy("g", "i").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v"))
    return {r["g"]: [x["v"] for x in r["v"]] for r in vectors.toLocalIterator()}


def prototypes(bundles: dict[str, list[int]]) -> tuple[list[str], np.ndarray]:
    """The languages in code point order and their unit prototypes, relative to the mean of all."""
    langs = sorted(bundles, key=lambda s: s.encode("utf-32-be"))
    if not langs:
        return [], np.zeros((0, DIM))
    m = np.array([bundles[g] for g in langs], dtype=np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        m -= m.mean(axis=0)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return langs, m


def predict(docs: DataFrame, bundles: dict[str, list[int]], keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep of docs, lang_pred and score (0 to 1: how far the best prototype is ahead of the others)."""
    langs, proto = prototypes(bundles)
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    frame = docs.select(*own, F.col(text).alias("x_"))
    kinds = "".join(f"k{i} {frame.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))

    def one(enc: Encoder, t: str | None) -> tuple[str, float]:
        keys, counts = enc.grams(t or "")
        if not len(keys) or not langs:
            return UNKNOWN, 0.0
        v = enc.bundle(keys, counts)
        norm = np.linalg.norm(v)
        cosines = np.round(proto @ v / (norm if norm > 0 else 1.0), 9)
        best = int(np.argmax(cosines))
        return langs[best], float(1 / np.exp(SHARPNESS * (cosines - cosines[best])).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for batch in batches:
            found = [one(enc, t) for part in slices(batch, "x_") for t in part.column("x_").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])

    return over_batches(frame, run, f"{kinds}lang_pred string, score double").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model of this subpackage learns from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
