"""BPE encoding and decoding with a byte-level vocabulary file.

Method: a pair occurrence index. The distinct words of a batch lie in one array of symbols; every adjacent pair that
has a rank is mapped to all its positions; active ranks are applied in ascending order, each to all its positions at
once, and the lists of the pairs that change are updated. A merge only makes pairs of higher ranks, so one ascending
pass is complete. Texts are split into chunks (one optional blank and what follows up to the next white space, or a
run of white space); a chunk's ids don't depend on its surroundings and are kept in a bounded table.

Defined results: a null text is an empty one, with no ids; ids decode to the text again; texts are whole, whatever
their length; repeated rows and null keys pass through; an empty table gives an empty result; only the named
columns are read. Memory: one batch slice, its distinct chunks, and the bounded table of chunks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import by_batch, slices

_WS = "\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: The public word pattern of this vocabulary family (fixed value).
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Chunks that a worker keeps.
KEPT_CHUNKS = 200_000
#: Bytes of text that are split into chunks at once.
SLICE = 1 << 20
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """A byte-level BPE vocabulary with its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max(*vocab.values(), *added.values()) + 1
        self.byte_id = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.token = [b""] * self.size
        for s, i in vocab.items():
            self.token[i] = bytes(of_letter[c] for c in s) if all(c in of_letter for c in s) else s.encode()
        for s, i in added.items():
            self.token[i] = s.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.left, self.right = np.divmod(keys, self.size)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = {s: np.uint32(i).tobytes() for s, i in added.items()}
        self.kept: dict[str, bytes] = dict(self.added)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; _NONE where no merge has it or a symbol is a border."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", dtype=np.uint8)
        borders = np.concatenate([[0], np.cumsum(sizes + 1)])
        sym = self.byte_id[text]
        sym[borders] = -1
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray, ranks: np.ndarray) -> None:
            """Adds positions to the lists of their pairs' ranks."""
            keep = ranks != _NONE
            at, ranks = at[keep], ranks[keep]
            if len(at) == 1:
                groups = [(int(ranks[0]), at)]
            else:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                groups = zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True) if len(at) else ()
            for r, part in groups:
                if r in lists:
                    lists[r].append(part)
                else:
                    lists[r] = [part]
                    heapq.heappush(active, r)

        index(np.arange(n - 1), self.rank(sym[:-1], sym[1:]))
        while active:
            r = heapq.heappop(active)
            parts, a, b = lists.pop(r), self.left[r], self.right[r]
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            at = at[sym[at] == a]
            after = nxt[at]
            live = sym[after] == b
            at, after = at[live], after[live]
            if a == b and len(at) > 1:  # in a run of equal symbols each is used once, from the left
                keep, used = [], -1
                for p, q in zip(at.tolist(), after.tolist(), strict=True):
                    keep.append(p != used)
                    used = q if p != used else used
                at, after = at[keep], after[keep]
            if not len(at):
                continue
            sym[at], sym[after] = self.merged[r], -2
            nxt[at] = nxt[after]
            prv[nxt[at]] = at
            before, behind = prv[at], nxt[at]
            here = sym[at]
            index(np.concatenate([before, at]), np.concatenate([self.rank(sym[before], here), self.rank(here, sym[behind])]))
        live = sym >= 0
        ids = sym[live].astype("<u4").tobytes()
        ends = 4 * np.cumsum(live)[borders]
        return [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        table, seen = self.kept, set()
        split, find = self.special, _CHUNK.findall
        chunks = []
        for t in texts:
            if split and split.search(t):
                c = [c for x in split.split(t) for c in ((x,) if x in self.added else find(x))]
            else:
                c = find(t)
            chunks.append(c)
            seen.update(c)
        if new := list(seen.difference(table)):
            if len(table) + len(new) > KEPT_CHUNKS and len(table) > len(self.added):
                table.clear()
                table.update(self.added)
                return self.encode(texts)
            words = list(map(_WORD.findall, new))
            distinct = list({w for ws in words for w in ws})
            ids = dict(zip(distinct, self.merge_words([w.encode() for w in distinct]), strict=True))
            table.update((c, ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])) for c, ws in zip(new, words, strict=True))
        return [b"".join(map(table.__getitem__, c)) for c in chunks]

    def decode(self, ids: bytes) -> str:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The vocabulary at path, once in each worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _over_texts(df: DataFrame, keep: list[str], column: str, fn, out: str) -> DataFrame:
    """Columns keep of df and what fn makes of each slice of column."""
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    frame = df.select(*own, F.col(column).alias("x"))
    kinds = ", ".join(f"k{i} {frame.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fn(part.column("x").to_pylist()) for part in slices(batch, "x", SLICE)]
        more = {k: pa.concat_arrays([m[k] for m in made]) for k in made[0]}
        return pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), *more.values()], names=[*(f"k{i}" for i in range(len(keep))), *more])

    return by_batch(frame, run, f"{kinds}{', ' * bool(keep)}{out}").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep and ids: the token ids of text as little-endian unsigned 32-bit integers."""
    return _over_texts(df, keep, text, lambda x: {"ids": pa.array(codec(path).encode([t or "" for t in x]), pa.binary())}, "ids binary")


def decode(df: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns keep and decoded: the text of ids."""
    return _over_texts(df, keep, ids, lambda x: {"decoded": pa.array([codec(path).decode(b or b"") for b in x], pa.string())}, "decoded string")


def digest(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep, n_tokens, ids_sha256 and decoded_sha256: encodes, decodes the ids, and keeps digests of both."""

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        c = codec(path)
        ids = c.encode([t or "" for t in texts])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {
            "n_tokens": pa.array([len(b) // 4 for b in ids], pa.int64()),
            "ids_sha256": pa.array([sha(b) for b in ids], pa.string()),
            "decoded_sha256": pa.array([sha(c.decode(b).encode()) for b in ids], pa.string()),
        }

    return _over_texts(df, keep, text, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
