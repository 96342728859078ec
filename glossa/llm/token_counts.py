"""Token counts with a sentencepiece BPE vocabulary, and what follows from them: truncation and budgets.

Method: prefix dynamic programming. A sequence of pieces is what BPE makes of their text exactly if it is so for each
two neighbours. So each prefix of a text has one last piece: the piece that ends there and that stands the test
behind the last piece of the prefix before it. One pass from left to right finds the last piece and the exact number
of tokens of every prefix; a limit or a budget is then a look into that list, with nothing encoded again. No piece
has a blank behind another letter, so a text falls apart into runs of blanks with what follows them, each with a list
of its own; lists of short runs are kept in a bounded table.

Defined results: a null text is an empty one with 0 tokens; a text isn't cut, whatever its length (a long run without blanks goes forward in windows of bounded size); strings that look
like control tokens are ordinary text; letters that the vocabulary lacks take a token for each byte; repeated rows and
null keys pass through; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import by_batch, slices

BLANK = "▁"
_RUN = re.compile(f"{BLANK}+[^{BLANK}]*")
#: Runs and tests of two pieces that a worker keeps; longer runs aren't kept.
KEPT, KEPT_CHARS = 400_000, 64
#: Letters of the runs that go forward together.
BLOCK_CHARS = 400_000
#: Runs longer than this go forward one by one, in windows of bounded size.
LONG_CHARS, WINDOW_CHARS = 256, 1 << 15
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _width(letters: np.ndarray) -> np.ndarray:
    """The bytes of each letter in UTF-8."""
    return np.where(letters < 0x80, 1, np.where(letters < 0x800, 2, np.where(letters < 0x10000, 3, 4)))


class Counter:
    """The pieces of a BPE vocabulary with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
        self.pieces = list(self.score)
        self.longest = max(map(len, self.pieces))
        #: Stands for a letter that no piece has.
        self.unknown = len(self.pieces)
        hashes = np.array([self._hash(p) for p in self.pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], order.astype(np.int32)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[hashes >> np.uint64(44)] = True
        self.whole = np.array([self.merge(p) == [p] for p in self.pieces])
        self.fits: dict[int, bool] = {}
        self.slot_key, self.slot_fits = np.full(1 << 19, -1, dtype=np.int64), np.zeros(1 << 19, dtype=bool)
        self.totals: dict[str, int] = {}

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(_BASE) + (ord(c) + 1) * int(_MIX)) & (2**64 - 1)
        return h

    def merge(self, s: str) -> list[str]:
        """The pieces of a short text: again and again the best of the pairs, the first of equals, becomes one."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the text of each two pieces falls into exactly these two."""
        key = left.astype(np.int64) * (self.unknown + 1) + right
        slot = (key * 0x9E3779B1 >> 7) & (len(self.slot_key) - 1)
        missing = np.flatnonzero((self.slot_key[slot] != key) & (left != self.unknown))
        if not len(missing):
            return self.slot_fits[slot] | (left == self.unknown)
        keys, where = np.unique(key[missing], return_inverse=True)
        known = np.fromiter(map(self.fit_together, keys.tolist()), dtype=bool, count=len(keys))[where]
        out = self.slot_fits[slot] | (left == self.unknown)
        out[missing] = known
        self.slot_key[slot[missing]], self.slot_fits[slot[missing]] = key[missing], known  # of two keys for a slot the last stays
        return out

    def fit_together(self, key: int) -> bool:
        """Whether the text of the two pieces of key falls into exactly these two."""
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > KEPT:
                self.fits.clear()
            a, b = self.pieces[key // (self.unknown + 1)], self.pieces[key % (self.unknown + 1)]
            known = self.fits[key] = self.merge(a + b) == [a, b]
        return known

    def ending_here(self, letters: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
        """For each size up to most, the piece of that size that ends at each letter and lies in the letter's run, or -1."""
        n = len(letters)
        mixed, h = (letters.astype(np.uint64) + np.uint64(1)) * _MIX, np.zeros(n, dtype=np.uint64)
        found = np.full((min(self.longest, max(most, 1)), n), -1, dtype=np.int32)
        for size in range(1, min(self.longest, most) + 1):
            h = np.concatenate([np.zeros(1, dtype=np.uint64), h[:-1]]) * _BASE + mixed
            at = np.flatnonzero(self.seen[h >> np.uint64(44)] & (place >= size - 1))
            i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            same = self.hashes[i] == h[at]
            found[size - 1, at[same]] = self.of_hash[i[same]]
        return found

    def windows(self, run: str) -> Iterator[list[int]]:
        """The number of tokens of each prefix of a long run, window by window.

        What a window needs of those before it are the last pieces and numbers of as many letters as the longest piece has.
        """
        back = self.longest
        last, count = [], []
        for begin in range(0, len(run), WINDOW_CHARS):
            seen = run[max(0, begin - back) : begin + WINDOW_CHARS]
            skip = begin - max(0, begin - back)
            letters = np.frombuffer(seen.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            found = self.ending_here(letters, np.arange(len(letters)), len(letters))[:, skip:]
            size, end = np.nonzero(found >= 0)
            order = np.lexsort((-size, end))
            size, end = size[order], end[order]
            pieces, sizes = found[size, end].tolist(), (size + 1).tolist()
            ends = np.searchsorted(end, np.arange(found.shape[1] + 1)).tolist()
            width = _width(letters[skip:]).tolist()
            last, count = last[-back:], count[-back:]
            kept = len(last)
            for i in range(found.shape[1]):
                at = kept + i
                for j in range(ends[i], ends[i + 1]):
                    size, piece = sizes[j], pieces[j]
                    if size == begin + i + 1:
                        fits = self.whole[piece]
                    elif size == 1:  # a letter on its own
                        fits = True
                    else:
                        left = last[at - size]
                        fits = left == self.unknown or self.fit_together(left * (self.unknown + 1) + piece)
                    if fits:
                        last.append(piece)
                        count.append(1 + (count[at - size] if size <= at else 0))
                        break
                else:
                    last.append(self.unknown)
                    count.append(width[i] + (count[at - 1] if at else 0))
            yield count[kept:]

    def prefix_table(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each prefix of each run, in one array, and where each run begins in it.

        The runs go forward in step: all first letters, all second letters, and so on.
        """
        sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        letters = np.frombuffer("".join(runs).encode("utf-32-le"), dtype=np.uint32)
        n = len(letters)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(n) - np.repeat(starts, sizes)
        found = self.ending_here(letters, place, int(sizes.max(initial=0)))
        width = _width(letters)
        last, count = np.full(n, self.unknown, dtype=np.int32), np.zeros(n, dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin, size_of = starts[order], sizes[order]
        for t in range(1, int(sizes.max(initial=0)) + 1):
            open_ = begin[: np.searchsorted(-size_of, -t, side="right")] + t - 1
            for size in range(min(self.longest, t), 1 if t > 1 else 0, -1):
                piece = found[size - 1, open_]
                there = np.flatnonzero(piece >= 0)
                if not len(there):
                    continue
                e, p = open_[there], piece[there]
                ok = self.whole[p] if size == t else self.stand(last[e - size], p)
                e, p = e[ok], p[ok]
                last[e] = p
                count[e] = 1 if size == t else count[e - size] + 1
                keep = np.ones(len(open_), dtype=bool)
                keep[there[ok]] = False
                open_ = open_[keep]
            alone = found[0, open_]  # what is left is a letter on its own
            last[open_] = np.where(alone >= 0, alone, self.unknown)
            count[open_] = np.where(alone >= 0, 1, width[open_]) + (count[open_ - 1] if t > 1 else 0)
        return count, starts

    def tables(self, runs: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """prefix_table of the runs in blocks of bounded size, runs of like sizes together."""
        block, chars = [], 0
        for run in sorted(runs, key=len):
            if block and chars + len(run) > BLOCK_CHARS:
                yield block, *self.prefix_table(block)
                block, chars = [], 0
            block.append(run)
            chars += len(run)
        if block:
            yield block, *self.prefix_table(block)

    def runs(self, text: str) -> list[str]:
        """The runs of a text behind the blank that the library puts first."""
        return _RUN.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        runs, totals, seen = list(map(self.runs, texts)), self.totals, set()
        for r in runs:
            seen.update(r)
        if len(totals) > KEPT:
            totals.clear()
        large = {}
        for run in [r for r in seen if len(r) > LONG_CHARS]:
            for counts in self.windows(run):
                large[run] = counts[-1]
        for block, count, starts in self.tables([r for r in seen.difference(totals) if len(r) <= LONG_CHARS]):
            ends = np.append(starts[1:], len(count)) - 1
            (totals if len(block[-1]) <= KEPT_CHARS else large).update(zip(block, count[ends].tolist(), strict=True))
        if large:
            return [sum([totals[x] if x in totals else large[x] for x in r]) for r in runs]
        return [sum(map(totals.__getitem__, r)) for r in runs]

    def prefix_counts(self, text: str) -> list[int]:
        """The number of tokens of each prefix of text; entry i is for the first i code points."""
        runs = self.runs(text)
        lists = {r: np.concatenate(list(map(np.array, self.windows(r)))) for r in set(runs) if len(r) > LONG_CHARS}
        for block, count, starts in self.tables([r for r in set(runs) if len(r) <= LONG_CHARS]):
            lists.update(zip(block, np.split(count, starts[1:]), strict=True))
        out, base = [0], 0
        for k, run in enumerate(runs):
            out += (base + lists[run][k == 0 :]).tolist()
            base += int(lists[run][-1])
        return out

    def fit(self, text: str, budget: int) -> int:
        """The code points of the longest prefix of text with at most budget tokens."""
        return max(i for i, n in enumerate(self.prefix_counts(text)) if n <= budget)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The vocabulary at path, once in each worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _made(df: DataFrame, keep: list[str], text: str, fn, kind: pa.DataType, out: str) -> DataFrame:
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    frame = df.select(*own, F.col(text).alias("x"))
    kinds = "".join(f"k{i} {frame.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.chunked_array([pa.array(fn([t or "" for t in part.column("x").to_pylist()]), kind) for part in slices(batch, "x")], kind).combine_chunks()
        return pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), found], names=[*(f"k{i}" for i in range(len(keep))), "made"])

    return by_batch(frame, run, f"{kinds}made {out}").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def token_counts(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep and n_tokens, the exact number of tokens of the whole text."""
    return _made(df, keep, text, lambda x: counter(path).counts(x), pa.int64(), "long").withColumnRenamed("made", "n_tokens")


def prefix_counts(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep and counts: entry i is the number of tokens of the first i code points."""
    return _made(df, keep, text, lambda x: list(map(counter(path).prefix_counts, x)), pa.list_(pa.int64()), "array<long>").withColumnRenamed("made", "counts")


def fit_to_budget(df: DataFrame, path: str, budget: int, keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep and n_fit: the code points of the longest prefix that takes at most budget tokens."""
    return _made(df, keep, text, lambda x: [counter(path).fit(t, budget) for t in x], pa.int64(), "long").withColumnRenamed("made", "n_fit")
