"""Headword search: substring matches over compact forms, in tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import normalize_compact, word_starts
from glossa.sources.shared import materialised

LIMIT = 400
#: A batch of up to this many queries is sent to every task; a larger one meets the headwords on two-letter grams.
BROADCAST_QUERIES = 16
#: Headwords with one gram that meet its queries in one task, about.
GRAM_ROWS = 20_000


def prepared(queries: DataFrame) -> DataFrame:
    """HWS01: query_id, qc (compact) and breaks (offsets where the user typed one); empty queries go."""
    rows = queries.select("query_id", normalize_compact("q").alias("qc"), word_starts("q").alias("breaks"))
    return rows.where("qc <> ''")


def _tier():  # noqa: ANN202
    """HWS03, HWS04: the best tier of the valid matches of qc in compact; null where none is valid.

    A match at the beginning is always valid and the best. Then those where a word starts are looked at, then the rest.
    """
    c, q, starts, breaks = (F.col(x) for x in ("compact", "qc", "starts", "breaks"))
    here = lambda p: F.substring(c, p + 1, F.length(q)) == q

    def unasked(p):  # noqa: ANN001, ANN202
        """A word starts inside the match where the query has no break."""
        return F.exists(starts, lambda s: (s > p) & (s < p + F.length(q)) & ~F.array_contains(breaks, s - p))

    whole = lambda p: F.array_contains(starts, p + F.length(q)) | (p + F.length(q) == F.length(c))
    places = F.sequence(F.lit(1), F.greatest(F.length(c) - F.length(q), F.lit(1)))
    return (
        F.when(c == q, 0)
        .when(F.startswith(c, q), 1)
        .when(F.exists(starts, lambda p: (p > 0) & here(p) & (~unasked(p) | whole(p))), 2)
        .when(F.exists(places, lambda p: here(p) & ~unasked(p)), 3)
    )


def _grams(text: str):  # noqa: ANN202
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(F.col(text), i, F.lit(2))))


def _met_by_gram(headwords: DataFrame, queries: DataFrame) -> DataFrame:
    """Headwords that contain a query of two letters or more.

    Each query is looked up by the one of its grams that the fewest headwords have; a gram that many have is split
    into parts, and its queries are repeated for each. A query with a gram that no headword has finds nothing.
    """
    by_gram = headwords.where(F.length("compact") > 1).withColumn("gram", F.explode(_grams("compact")))
    counts = by_gram.groupBy("gram").agg(F.count("*").alias("rows"))
    asked = queries.withColumn("all_grams", F.size(_grams("qc"))).withColumn("gram", F.explode(_grams("qc"))).join(counts, "gram")
    rarest = asked.groupBy("query_id", "qc", "breaks", "all_grams").agg(F.count("*").alias("known"), F.min(F.struct("rows", "gram")).alias("rare")).where("known = all_grams")
    rarest = materialised(rarest.select("query_id", "qc", "breaks", "rare.gram", F.ceil(F.col("rare.rows") / GRAM_ROWS).cast("int").alias("parts")))
    wanted = rarest.select("gram", "parts").distinct()
    split = by_gram.join(wanted, "gram").withColumn("part", F.pmod(F.xxhash64("kind", "line"), F.col("parts")).cast("int")).drop("parts")
    repeated = rarest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return split.join(repeated, ["gram", "part"]).where(F.contains("compact", "qc")).drop("gram", "part")


def matches(headwords: DataFrame, queries: DataFrame, broadcast_limit: int = BROADCAST_QUERIES) -> DataFrame:
    """HWS02-05: query_id, kind, line, display, tier of every match."""
    q = prepared(queries)
    long_, short = q.where(F.length("qc") > 1), q.where(F.length("qc") == 1)
    if q.limit(broadcast_limit + 1).count() <= broadcast_limit:
        met = headwords.join(F.broadcast(long_), F.contains(headwords["compact"], F.col("qc")))
    else:
        met = _met_by_gram(headwords, long_)
    tiers = met.withColumn("tier", _tier()).where("tier IS NOT NULL").select("query_id", "kind", "line", "display", "tier")
    first = headwords.where(F.length("compact") > 0).withColumn("qc", F.substring("compact", 1, 1)).join(short.select("query_id", "qc"), "qc")
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("line"))
    single = first.withColumn("place", place).where(F.col("place") <= LIMIT)
    return tiers.unionByName(single.select("query_id", "kind", "line", "display", F.when(F.length("compact") == 1, 0).otherwise(1).alias("tier")))


def search_headwords(headwords: DataFrame, queries: DataFrame, phrases: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """HWS01-08: query_id, rank, id, w, tier, is_phrase, parent.

    phrases: phrase_id, parent_id; words: id, word.
    """
    # narrow rows are ranked; what is shown is joined to those that stay
    found = matches(headwords, queries).select("query_id", "tier", (F.col("kind") == "phrase").alias("is_phrase"), "kind", "line")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "is_phrase", "line"))
    shown = headwords.select("kind", "line", "display")
    top = found.withColumn("rank", rank).where(F.col("rank") <= LIMIT).join(shown, ["kind", "line"])
    if phrases is not None:
        parents = phrases.select(F.col("phrase_id").alias("line"), F.col("parent_id")).withColumn("kind", F.lit("phrase"))
        top = top.join(parents, ["kind", "line"], "left")
        top = top.join(words.select(F.col("id").alias("parent_id"), F.col("word").alias("parent")), "parent_id", "left")
    else:
        top = top.withColumns({"parent_id": F.lit(None).cast("long"), "parent": F.lit(None).cast("string")})
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), F.coalesce("parent_id", "line").alias("id"), F.col("display").alias("w"), "tier", "is_phrase", "parent")


def lookup(headwords: DataFrame, words: DataFrame) -> DataFrame:
    """HWS09: query_id and id of the entries whose compact form is that of q; texts that normalise to nothing find nothing."""
    wanted = words.select("query_id", normalize_compact("q").alias("compact")).where("compact <> ''")
    return headwords.where("kind = 'entry'").join(wanted, "compact").select("query_id", F.col("line").alias("id"))
