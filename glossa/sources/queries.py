"""Query sources: typed texts and deep links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_texts(df: DataFrame, query_id: str, text: str) -> DataFrame:
    """SRC09: query_id, q."""
    return df.select(F.col(query_id).cast("long").alias("query_id"), F.col(text).alias("q"))


def deep_link(url: Column) -> tuple[Column, Column]:
    """SRC10: the q parameter behind the first ? of a link (null where it has none or is empty), and whether it asks to go on."""
    params = F.regexp_extract(url, r"\?([^#]*)", 1)
    value = lambda name: F.regexp_extract(params, rf"(?:^|&){name}=([^&]*)", 1)
    q = F.try_url_decode(value("q"))
    return F.when(q != "", q), value("go") == "1"


def chosen(hits: DataFrame, links: DataFrame) -> DataFrame:
    """The entry that a link with go opens: the first exact headword that isn't a phrase."""
    exact = hits.where("tier = 0 AND NOT is_phrase").groupBy("query_id").agg(F.min_by("id", "rank").alias("id"))
    return links.where("go").join(exact, "query_id").select("query_id", "id")
