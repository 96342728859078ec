"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step is an aggregation (the smallest neighbour of each node, partially aggregated before the shuffle) and a join
that gives it to each of the node's links. The links of a hub, a node with a large share of all links, don't meet in
one task: the few hubs (their number is bounded by the share) are broadcast, the other nodes are joined by shuffle.
Each round is a table in the shared folder that replaces the one before. A component that has become a star leaves, so
a long chain costs rounds for its own links only. Nothing comes to the driver but the number of links.

Defined results: links of a node with itself and repeated links add nothing; nodes without links have no row; null
nodes have none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import discard, written

#: A hub has at least this share of all rows, and so many; there are at most HUBS of them.
HUBS, HUB_ROWS = 1024, 1000


def attached(rows: DataFrame, each: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with each (one row for each key, with n_ its rows in rows), a key with a large share of the total rows by broadcast."""
    limit = max(HUB_ROWS, -(-total // HUBS))
    hot = each.where(F.col("n_") >= limit).drop("n_").withColumn("hot_", F.lit(True))
    others = [c for c in hot.columns if c not in (key, "hot_")]
    marked = rows.join(F.broadcast(hot), key, "left")
    plain = marked.where("hot_ IS NULL").select(*rows.columns).join(each.where(F.col("n_") < limit).drop("n_"), key)
    return plain.select(*rows.columns, *others).unionByName(marked.where("hot_").select(*rows.columns, *others))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (its smallest node) of every node that has a link to another."""
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v AND u IS NOT NULL AND v IS NOT NULL").distinct()
    links = written(links.withColumn("open", F.lit(True)))
    found = links.select("u", "v").limit(0)
    while many := links.count():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "open"))
        # the smallest of each node's neighbourhood, the node's greater neighbours, and whether these are all and none is open: a star
        star = F.min((F.col("v") > F.col("u")) & ~F.col("open")).alias("star")
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("n_"), star))
        # large star: greater neighbours move to the smallest of the neighbourhood
        large = attached(links.select(F.col("v").alias("u"), F.col("u").alias("w")), least, "u", many).select(F.col("w").alias("u"), F.col("m").alias("v"), "star").where("u <> v")
        large = written(large.distinct())
        stars = written(large.where("star").select("u", "v"))
        found = found.unionByName(stars)
        rest = large.where("NOT star").select("u", "v")
        # small star: a node and its smaller neighbours move to the smallest of them; a node with several of these, or with greater ones, is open
        both = rest.withColumn("up", F.lit(0)).unionByName(rest.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(1).alias("up")))
        down = both.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("n_"), F.max("up").alias("up")).where("n_ > 0")
        down = written(down.select("u", "m", "n_", ((F.col("n_") > 1) | (F.col("up") > 0)).alias("open")))
        pairs = F.array(F.struct("u", F.col("m").alias("v"), "open"), F.struct(F.col("v").alias("u"), F.col("m").alias("v"), "open"))
        small = attached(rest, down, "u", rest.count()).select(F.explode(pairs).alias("x")).select("x.u", "x.v", "x.open").where("u <> v")
        before, links = links, written(small.groupBy("u", "v").agg(F.max("open").alias("open")))
        discard(before, least, large, down)
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
