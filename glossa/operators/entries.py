"""Looking entries up: by id, neighbours, random, snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.markup import plain_text
from glossa.functions.text import snippet


def entries_by_id(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """ENT01, ENT04: the entry of each id with its neighbours' headwords; unknown ids give nulls.

    Ids are dense, so neighbours are equal joins on id - 1 and id + 1; no table is sorted.
    """
    words = entries.select("id", "word")
    at = lambda step, name: words.select((F.col("id") + step).alias("id"), F.col("word").alias(name))
    found = ids.select("id").distinct().join(entries, "id", "left")
    return found.join(at(1, "prev"), "id", "left").join(at(-1, "next"), "id", "left")


def random_entry(entries: DataFrame, seed: int) -> DataFrame:
    """ENT05: one entry, the same for the same seed: the id whose hash is smallest. Only ids are compared; no entry without an id."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    drawn = entries.where("id IS NOT NULL").agg(F.min(F.struct(hashed.alias("h"), "id"))["id"].alias("id")).where("id IS NOT NULL")
    return entries.join(F.broadcast(drawn), "id").limit(1)


def snippets(entries: DataFrame, ids: DataFrame, terms: list[str]) -> DataFrame:
    """TXT03, TXT04: id, pron, text for each id, around the first of the shared terms."""
    words = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    return entries.join(ids.select("id").distinct(), "id", "left_semi").select("id", "pron", snippet(plain_text("body"), words).alias("text"))
