"""Exact top-k search by inner product.

Method: norm-sorted inner products. Vectors lie in chunks by descending length and are rotated by the right singular
vectors of the whole table, so that the first coordinates carry most of a product. For each query a chunk is passed
over if |q| times its longest vector is below the k-th score so far (Cauchy-Schwarz); in a chunk, the partial sum over
the first coordinates plus the product of the residual lengths bounds each score, and only what the bound leaves gets
its exact whole-number product. The longest vectors, a few MB, are broadcast and searched first, where each block of
queries lies; they give each query its k-th score and id, and each block the last chunk it needs. Only numbers of
blocks and chunks are paired then; vectors follow to the pairs that the bound leaves, a chunk meeting its blocks in
groups of bounded size. What doesn't come before a query's k-th score and id isn't told, so copies of one vector are
k results for a query, in whatever chunks they lie.

The singular vectors come from the sum of outer products over all rows (a d x d matrix). One row per chunk of vectors
(4,096) comes to the driver.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; vectors of
different dimension don't meet; equal scores rank by smaller id; a query isn't its own result (rows with its id); rows
with a null id take no part; repeated rows each are results; components beyond 2^62 and scores beyond the range of
long are held to that range; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import discard, over_batches, written

SCALE, LARGEST = 64, 1 << 62
CHUNK, QUERY_BLOCK, STEP = 4096, 512, 512
#: The longest vectors that are broadcast: so many of a dimension, and so many bytes in all.
HEAD, HEAD_BYTES = 4096, 16 << 20
#: Blocks of queries that meet a chunk in one group, about.
GROUP = 64
_NONE = np.iinfo(np.int64).min
_PACKED = pa.schema([("raw", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("data", pa.binary())])
_PACKED_SQL = "raw long, dim int, n int, longest double, ids binary, data binary"


def whole_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v (whole numbers floor(SCALE * x)), dim and length of each vector that takes part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = ~F.exists("v_", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("v_") > 0)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v_")).where(F.col("id").isNotNull() & F.col("v_").isNotNull()).where(sound)
    held = lambda x: F.greatest(F.least(F.floor(x), F.lit(float(LARGEST))), F.lit(-float(LARGEST))).cast("long")
    rows = rows.select("id", F.transform("v_", lambda x: held(x * SCALE)).alias("v"))
    return rows.select("id", "v", F.size("v").alias("dim"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("length"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return np.asarray(v.flatten()).reshape(batch.num_rows, -1)


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the right singular vectors, those of the largest singular values first."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims).tolist():
                m = _matrix(batch.filter(pa.array(dims == d))).astype(np.float64)
                sums[d] = sums.get(d, 0) + m.T @ m
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(np.arange(d * d), pa.int32()), pa.array(s.ravel())], names=["dim", "i", "x"])

    cells = over_batches(vectors.select("v", "dim"), outer, "dim int, i int, x double").groupBy("dim", "i").agg(F.sum("x").alias("x")).toArrow()
    out = {}
    dim, i, x = (np.asarray(cells.column(c).combine_chunks()) for c in ("dim", "i", "x"))
    for d in np.unique(dim).tolist():
        g = np.zeros(d * d)
        g[i[dim == d]] = x[dim == d]
        out[d] = np.linalg.eigh(g.reshape(d, d))[1][:, ::-1].copy()
    return out


def _packed(rows: DataFrame, limit: int) -> DataFrame:
    """Rows, in their order in each partition, in blocks of at most limit vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        raw = TaskContext.get().partitionId() << 32
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(dims)) + 1, [len(dims)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for i in range(a, b, limit):
                    part = batch.slice(i, min(limit, b - i))
                    cols = [raw, int(dims[a]), part.num_rows, float(np.max(np.asarray(part.column("length")))), np.asarray(part.column("id"), dtype="<i8").tobytes(), _matrix(part).astype("<i8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, _PACKED.types, strict=True)], schema=_PACKED)
                    raw += 1

    return over_batches(rows, run, _PACKED_SQL)


class _Chunk:
    """Vectors with their rotated heads and residual lengths, longest first."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, rotation: np.ndarray, ordered: bool = True):
        self.exact = data.astype(np.float64)
        self.length = np.linalg.norm(self.exact, axis=1)
        self.ids, self.whole = ids, data
        if ordered:
            order = np.argsort(-self.length, kind="stable")
            self.exact, self.length, self.ids, self.whole = (x[order] for x in (self.exact, self.length, ids, data))
        turned = self.exact @ rotation
        self.h = max(1, data.shape[1] // 4)
        self.head, self.rest = turned[:, : self.h], np.linalg.norm(turned[:, self.h :], axis=1)
        self.small = float(np.abs(self.exact).max(initial=0)) ** 2 * data.shape[1] < 2**52


def _slack(lengths: np.ndarray, longest: float) -> np.ndarray:
    """More than what rounding takes from a bound."""
    return 1e-9 * (1 + lengths * longest) + 1e-6


def _exact(queries: _Chunk, chunk: _Chunk, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The whole-number products of rows q with rows c."""
    if queries.small and chunk.small:
        parts = [np.einsum("ij,ij->i", queries.exact[q[i : i + 65536]], chunk.exact[c[i : i + 65536]]) for i in range(0, len(q), 65536)]
        return np.concatenate(parts).astype(np.int64)
    low, high = _NONE, np.iinfo(np.int64).max  # wide numbers: exact in Python's integers
    return np.array([min(max(sum(x * y for x, y in zip(queries.whole[i].tolist(), chunk.whole[j].tolist(), strict=True)), low), high) for i, j in zip(q.tolist(), c.tolist(), strict=True)], dtype=np.int64)


def search(queries: _Chunk, chunk: _Chunk, kth: np.ndarray, kth_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of the chunk's k best for each query, of those before the query's k-th score and id; the new k-th ones."""
    kth, kth_id = kth.copy(), kth_id.copy()
    got_row, got_id, got_score = (np.zeros(0, dtype=np.int64) for _ in range(3))
    for a in range(0, len(chunk.ids), STEP):
        part = slice(a, a + STEP)
        threshold = np.where(kth == _NONE, -np.inf, kth.astype(np.float64))
        slack = _slack(queries.length, chunk.length[a])
        live = np.flatnonzero(queries.length * chunk.length[a] + slack >= threshold)
        if not len(live):
            break
        bound = queries.head[live] @ chunk.head[part].T + np.outer(queries.rest[live], chunk.rest[part]) + slack[live, None]
        q, c = np.nonzero((bound >= threshold[live, None]) & (queries.ids[live, None] != chunk.ids[None, part]))
        if not len(q):
            continue
        if queries.small and chunk.small and 4 * len(q) > bound.size:  # the bound leaves much: all at once is faster
            s = (queries.exact[live] @ chunk.exact[part].T)[q, c].astype(np.int64)
        else:
            s = _exact(queries, chunk, live[q], a + c)
        q, ids = live[q], chunk.ids[a + c]
        keep = (s > kth[q]) | ((s == kth[q]) & (ids <= kth_id[q]))
        row, ids, s = (np.concatenate(x) for x in ((got_row, q[keep]), (got_id, ids[keep]), (got_score, s[keep])))
        order = np.lexsort((ids, ~s, row))  # ~s falls as s rises, over the whole range of long
        row, ids, s = row[order], ids[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        best = place < k
        got_row, got_id, got_score = row[best], ids[best], s[best]
        last = place == k - 1
        kth[row[last]], kth_id[row[last]] = s[last], ids[last]
    return got_row, got_id, got_score, kth, kth_id


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["ids"], dtype="<i8"), np.frombuffer(r["data"], dtype="<i8").reshape(r["n"], -1)


class _Order:
    """The chunks of each dimension by descending length, numbered through, and the vectors to search first."""

    def __init__(self, packed: DataFrame):
        stats = packed.select("raw", "dim", "n", "longest").toArrow()
        raw, dim, n, longest = (np.asarray(stats.column(c).combine_chunks()) for c in ("raw", "dim", "n", "longest"))
        order = np.lexsort((raw, -longest, dim))
        self.raw, self.longest, dim, n = raw[order], longest[order], dim[order], n[order]
        dims = np.unique(dim)
        #: For each dimension its first chunk, that behind the broadcast ones, and that behind all.
        self.span: dict[int, tuple[int, int, int]] = {}
        left, heads = HEAD_BYTES, []
        for d in dims[np.argsort(-np.array([n[dim == d].sum() for d in dims]))].tolist() if len(dims) else []:
            a, b = (int(x) for x in np.searchsorted(dim, [d, d + 1]))
            behind = a
            while behind < b and n[a:behind].sum() < HEAD and 8 * d * int(n[behind]) <= left:
                left -= 8 * d * int(n[behind])
                behind += 1
            self.span[d] = (a, behind, b)
            heads += self.raw[a:behind].tolist()
        self.heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found: dict[int, list] = {}
        if heads:
            for r in packed.where(F.col("raw").isin(heads)).select("dim", "n", "ids", "data").toArrow().to_pylist():
                found.setdefault(r["dim"], []).append(_unpacked(r))
        for d, parts in found.items():
            self.heads[d] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def needed(self, d: int, queries: _Chunk, kth: np.ndarray) -> int:
        """One more than the last chunk of dimension d that some query needs."""
        _, behind, end = self.span[d]
        threshold = np.where(kth == _NONE, -np.inf, kth.astype(np.float64))
        rows = self.longest[behind:end]
        least, most = 0, len(rows)  # what a query needs of the sorted chunks is their beginning
        while least < most:
            middle = (least + most) // 2
            if np.any(queries.length * rows[middle] + _slack(queries.length, rows[middle]) >= threshold):
                least = middle + 1
            else:
                most = middle
        return behind + least


_ASKED = "raw long, dim int, n int, from_c int, to_c int, ids binary, data binary, kth binary, kth_id binary, row binary, found binary, score binary"
_FOUND = "query_id long, vec_id long, score long"


def _headed(blocks: DataFrame, order: _Order, turns: dict[int, np.ndarray], k: int) -> DataFrame:
    """Each block of queries with what the broadcast vectors give, and the chunks that it needs besides."""
    shared = blocks.sparkSession.sparkContext.broadcast((order, turns))
    names = [x.split()[0] for x in _ASKED.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in _ASKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, turns = shared.value
        heads = {}
        for batch in batches:
            for r in batch.to_pylist():
                d = r["dim"]
                queries = _Chunk(*_unpacked(r), turns[d], ordered=False)
                kth, kth_id = np.full(r["n"], _NONE), np.full(r["n"], np.iinfo(np.int64).max)
                row, ids, score = (np.zeros(0, dtype=np.int64) for _ in range(3))
                if d in order.heads:
                    if d not in heads:
                        heads[d] = _Chunk(*order.heads[d], turns[d])
                    row, ids, score, kth, kth_id = search(queries, heads[d], kth, kth_id, k)
                cols = [r["raw"], d, r["n"], order.span[d][1], order.needed(d, queries, kth), r["ids"], r["data"], *(x.astype("<i8").tobytes() for x in (kth, kth_id, row, ids, score))]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return over_batches(blocks, run, _ASKED)


def _told(asked: DataFrame) -> DataFrame:
    """What the broadcast vectors gave, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, row, found, score = (np.frombuffer(r[c], dtype="<i8") for c in ("ids", "row", "found", "score"))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return over_batches(asked.select("ids", "row", "found", "score"), run, _FOUND)


def _searched(rows: DataFrame, turns: dict[int, np.ndarray], k: int) -> DataFrame:
    """rows: for each chunk and group first the chunk (kind 0), then the group's blocks of queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, c = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["kind"] == 0:
                    chunk, c = _Chunk(*_unpacked(r), turns[r["dim"]]), r["c"]
                    continue
                if c != r["c"]:
                    raise ValueError("a block of queries without its chunk")
                queries = _Chunk(*_unpacked(r), turns[r["dim"]], ordered=False)
                kth, kth_id = (np.frombuffer(r[x], dtype="<i8") for x in ("kth", "kth_id"))
                row, ids, score, _, _ = search(queries, chunk, kth, kth_id, k)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(queries.ids[row]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return over_batches(rows, run, _FOUND)


def top_k(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", query_every: int = 20, k: int = 20) -> DataFrame:
    """For each row whose id is divisible by query_every its k best among all other rows: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    vectors = written(whole_vectors(df, vec_id, vector))
    turns = rotations(vectors)
    parts = max(1, -(-vectors.count() // CHUNK))
    by_length = [F.col("dim"), F.col("length").desc(), F.col("id")]
    packed = written(_packed(vectors.repartitionByRange(parts, *by_length).sortWithinPartitions(*by_length), CHUNK))
    asked = vectors.where(F.pmod("id", F.lit(query_every)) == 0)
    order = _Order(packed)
    dealt = max(1, parts * CHUNK // (query_every * QUERY_BLOCK))
    queries = _packed(asked.repartition(dealt).sortWithinPartitions(*by_length), QUERY_BLOCK)
    blocks = written(_headed(queries, order, turns, k))
    discard(vectors)
    # pairs are numbers only; the vectors follow to those that are left
    groups = -(-blocks.count() // GROUP)
    pairs = blocks.where("to_c > from_c").select("raw", F.explode(F.sequence("from_c", F.col("to_c") - 1)).alias("c")).withColumn("g", F.pmod(F.xxhash64("raw"), F.lit(max(groups, 1))).cast("int"))
    pairs = written(pairs)
    numbered = spark.createDataFrame([(raw, i) for i, raw in enumerate(order.raw.tolist())], "raw long, c int")
    none = F.lit(None).cast("binary")
    chunks = packed.join(numbered, "raw").join(pairs.select("c", "g").distinct(), "c").select("c", "g", F.lit(0).alias("kind"), "dim", "n", "ids", "data", none.alias("kth"), none.alias("kth_id"))
    meets = blocks.join(pairs, "raw").select("c", "g", F.lit(1).alias("kind"), "dim", "n", "ids", "data", "kth", "kth_id")
    together = chunks.unionByName(meets).repartition("c", "g").sortWithinPartitions("c", "g", "kind")
    every = _told(blocks).unionByName(_searched(together, turns, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
