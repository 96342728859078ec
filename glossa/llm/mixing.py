"""Mixing sources to target weights.

Method: Sainte-Lague apportionment of equal-token blocks. Each source's target is its share by weight, cut at a
number of passes over the source, the excess shared anew by weight. The blocks of the whole mix go to the sources by
highest quotients target / (2k + 1), and each source's blocks to its shards in the same way by shard size, so quotas
are integers. In a shard the documents stand in a seeded order; a quota takes whole passes and then a row of blocks
from a seeded start, and a document's words under the blocks are its taken words.

Shards are by a hash of the document, as many for a source as its rows need (SHARD_ROWS each, more where there would
be over SHARDS of them), so a source with a third of all rows is many even shards. One row per source comes to the
driver (the mix's own settings have one row per source too).

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, the last; sources
without words get target 0; a text of any length is a document of its size (its words are counted in the row); ties
of quotients go to the first source or shard; equal rows are interchangeable; reruns agree; an empty table gives an
empty result; no document takes more than max_passes times its size.
"""

from __future__ import annotations

import heapq
from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import SPACE, written

#: Rows of a shard, about, the shards of all sources at most (and one for each source), and words of a block at most.
SHARD_ROWS, SHARDS, BLOCK = 1024, 1 << 16, 64
#: Sources whose settings are sent to every task, at most; those of more are joined by shuffle.
BROADCAST_SOURCES = 1 << 16
SEED = 20240229


def targets(sizes: list[int], weights: list[float], max_passes: float) -> list[float]:
    """Each source's share of all sizes by weight, at most max_passes times its size; the excess goes to the rest by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0 and weights[i] > 0]
    left = total
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > max_passes * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in full:
            out[i] = float(max_passes * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def apportion(seats: int, votes: list[float], most: list[int]) -> list[int]:
    """Sainte-Lague: seats by highest quotients votes / (2k + 1), ties to the first, none above its most."""
    v, m = np.array(votes, dtype=np.float64), np.array(most, dtype=np.int64)
    able = (v > 0) & (m > 0)
    seats = min(int(seats), sum(m[able].tolist()))
    if seats <= 0:
        return [0] * len(votes)

    def given(x: float) -> np.ndarray:
        """The seats of quotients of at least x."""
        return np.where(able, np.minimum(np.floor((v / x + 1) / 2), m), 0).astype(np.int64)

    # a quotient that leaves some seats, closer and closer; then the highest quotients of the rest
    low, high = v[able].min() / (4 * int(m[able].max()) + 4), 2 * v[able].max()
    while high > low * (1 + 1e-12):
        middle = low + (high - low) / 2
        if given(middle).sum() <= seats:
            high = middle
        else:
            low = middle
        if not low < low + (high - low) / 2 < high:
            break
    got = given(high * (1 + 1e-9))
    heap = [(-v[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(able & (got < m)).tolist()]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < m[i]:
            heapq.heappush(heap, (-v[i] / (2 * got[i] + 1), i))
    return got.tolist()


def _quotas(shards: pd.DataFrame) -> pd.DataFrame:
    """The block quota of each shard of one source."""
    shards = shards.sort_values("shard")
    block, passes = int(shards["block"].iloc[0]), int(shards["passes"].iloc[0])
    blocks = [-(-int(n) // block) for n in shards["size"]]
    quota = apportion(int(shards["blocks"].iloc[0]), [float(n) for n in shards["size"]], [passes * b for b in blocks])
    return pd.DataFrame({"src": shards["src"], "shard": shards["shard"], "quota": quota, "shard_blocks": blocks})


def sizes(docs: DataFrame, text: str) -> DataFrame:
    """docs with _size, the words of text."""
    return docs.withColumn("_size", F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), "")).cast("long"))


def source_key(source: str) -> Column:
    """A source's name, null's own among them, in an order that is theirs."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("z"))


def row_key(columns: list[str], seed: int = SEED) -> Column:
    """What a row's place in the seeded order is by."""
    return F.xxhash64(F.lit(seed), *columns)


def shard_of(row: Column | str, shards: Column | str) -> Column:
    return F.pmod(F.xxhash64(row), F.col(shards) if isinstance(shards, str) else shards).cast("int")


def _near(df: DataFrame, sources: int) -> DataFrame:
    """A table of a row for each source, sent to every task where there are few."""
    return F.broadcast(df) if sources <= BROADCAST_SOURCES else df


def mix(docs: DataFrame, keep: list[str], source: str = "source", text: str = "text", weights: tuple[float, ...] = (1, 2, 3), max_passes: int = 3, seed: int = SEED) -> DataFrame:
    """Columns keep of docs and size, source_size, target (of the source) and taken.

    Sources in code point order, null last, weigh as weights, repeating.
    """
    return mixed_rows(docs, keep, source, text, weights, max_passes, seed).drop("src_", "row_", "shards_", "shard_")


def mixed_rows(docs: DataFrame, keep: list[str], source: str = "source", text: str = "text", weights: tuple[float, ...] = (1, 2, 3), max_passes: int = 3, seed: int = SEED) -> DataFrame:
    """What mix gives, with where each row stands: src_ (source_key), row_ (row_key of keep without the text), shards_ of the source, shard_."""
    key = source_key(source)
    mine = [F.col(c).alias(f"in_{c}") for c in keep]
    row = row_key([c for c in keep if c != text], seed)
    frame = sizes(docs.select(*mine, key.alias("_src"), row.alias("_row"), F.col(text).alias("_text")), "_text").drop("_text")
    frame = written(frame)
    # the letter before a source's name keeps code point order; null's own key comes last
    found = sorted((r["src"][0], r["src"][1:].encode("utf-32-be"), r["src"], r["size"], r["rows"]) for r in frame.groupBy(F.col("_src").alias("src")).agg(F.sum("_size").alias("size"), F.count("*").alias("rows")).toLocalIterator())
    size = [r[3] for r in found]
    shard_rows = max(SHARD_ROWS, -(-sum(r[4] for r in found) // SHARDS))
    shard_count = [-(-r[4] // shard_rows) for r in found]
    goal = targets(size, [w for w, _ in zip(cycle(weights), size, strict=False)], max_passes)
    least = min((g / s for g, s in zip(goal, shard_count, strict=True) if g > 0), default=0)
    block = max(1, min(BLOCK, int(least / 100)))
    blocks = apportion(round(sum(size) / block), goal, [max_passes * (n // block + s) for n, s in zip(size, shard_count, strict=True)])
    plan = docs.sparkSession.createDataFrame([(r[2], r[3], g, b, block, s, max_passes) for r, g, b, s in zip(found, goal, blocks, shard_count, strict=True)], "src string, source_size long, target double, blocks long, block long, shards int, passes int")
    frame = frame.join(_near(plan.select(F.col("src").alias("_src"), F.col("shards").alias("_shards")), len(found)), "_src").withColumn("_shard", shard_of("_row", "_shards"))
    shards = frame.groupBy(F.col("_src").alias("src"), F.col("_shard").alias("shard")).agg(F.sum("_size").alias("size"))
    quotas = shards.join(_near(plan, len(found)), "src").groupBy("src").applyInPandas(_quotas, "src string, shard int, quota long, shard_blocks long")
    # written, so that the small table is one relation of known size
    quotas = written(quotas.join(_near(plan.drop("passes", "blocks", "shards"), len(found)), "src"))
    order = Window.partitionBy("_src", "_shard").orderBy("_row", "_size", *[f"in_{c}" for c in keep if c != text]).rowsBetween(Window.unboundedPreceding, -1)
    placed = frame.withColumn("_from", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    joined = placed.join(quotas, (F.col("_src") == F.col("src")) & (F.col("_shard") == F.col("shard")))
    nb, span = F.col("shard_blocks"), F.col("block")
    full = F.when(nb > 0, F.floor(F.col("quota") / F.greatest(nb, F.lit(1)))).otherwise(0).cast("long")
    rest = F.col("quota") - full * nb
    begin = F.pmod(F.xxhash64(F.lit(seed), "_src", "_shard"), F.greatest(nb, F.lit(1)))
    low, high = F.col("_from"), F.col("_from") + F.col("_size")

    def under(a, b):  # noqa: ANN001, ANN202
        """Words of the document between blocks a and b."""
        return F.greatest(F.least(high, b * span) - F.greatest(low, a * span), F.lit(0))

    part = under(begin, F.least(begin + rest, nb)) + under(F.lit(0), F.greatest(begin + rest - nb, F.lit(0)))
    taken = (full * F.col("_size") + part).cast("long")
    return joined.select(*[F.col(f"in_{c}").alias(c) for c in keep], F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), F.col("_src").alias("src_"), F.col("_row").alias("row_"), F.col("_shards").alias("shards_"), F.col("_shard").alias("shard_"))
