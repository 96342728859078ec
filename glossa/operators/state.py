"""Keyed state: lists, favourites and history as views over an event log.

Events have an order (ts, event_id). Every view is an aggregation or a window by user and item; a user's log is
never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY, STRIP = 40, 24
FAVOURITES = "fav"


def history(events: DataFrame, limit: int = HISTORY) -> DataFrame:
    """STA04, STA09: user_id, item_id, ts, rank: each user's latest distinct items, newest first."""
    latest = events.groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("at.ts").desc(), F.col("at.event_id").desc()))
    return latest.withColumn("rank", rank).where(F.col("rank") <= limit).select("user_id", "item_id", F.col("at.ts").alias("ts"), F.col("rank").cast("long").alias("rank"))


def after_clear(events: DataFrame, op: str = "op") -> DataFrame:
    """STA05: events behind each user's last clear."""
    cleared = events.where(F.col(op) == "clear").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("cleared"))
    rest = events.where(F.col(op) != "clear").join(cleared, "user_id", "left")
    return rest.where(F.col("cleared").isNull() | (F.struct("ts", "event_id") > F.col("cleared"))).drop("cleared")


#: What the favourites are called until they are renamed, and a list that is created without a name.
FAVOURITES_NAME, NEW_NAME = "favourites", "new list"


def _lives(events: DataFrame) -> DataFrame:
    """user_id, list_id, since: the lists that exist, and when they were created. Ids that come back are new lists; favourites aren't created."""
    last = events.where("op IN ('create', 'delete')").where(F.col("list_id") != FAVOURITES).groupBy("user_id", "list_id").agg(F.max(F.struct("ts", "event_id", "op")).alias("last"))
    return last.where("last.op = 'create'").select("user_id", "list_id", F.struct("last.ts", "last.event_id").alias("since"))


def members(events: DataFrame) -> DataFrame:
    """STA01, STA02: user_id, list_id, item_id, added_at of the items in each list.

    A toggle flips membership, a remove ends it, and deleting a list ends all of its. On lists that don't exist
    neither does anything; favourites always exist. An item is in if an odd number of toggles follow the list's
    creation and the item's last remove.
    """
    at = F.struct("ts", "event_id")
    keys = ["user_id", "list_id", "item_id"]
    on_items = events.where("op IN ('toggle', 'remove')").select(*keys, "op", at.alias("at"))
    living = on_items.join(_lives(events), ["user_id", "list_id"], "left").where((F.col("list_id") == FAVOURITES) | (F.col("at") > F.col("since")))
    removed = living.where("op = 'remove'").groupBy(*keys).agg(F.max("at").alias("removed"))
    live = living.where("op = 'toggle'").join(removed, keys, "left").where(F.col("removed").isNull() | (F.col("at") > F.col("removed")))
    counted = live.groupBy(*keys).agg(F.count("*").alias("n"), F.max("at.ts").alias("added_at"))
    return counted.where("n % 2 = 1").select(*keys, "added_at")


def lists(events: DataFrame) -> DataFrame:
    """STA03: user_id, list_id, name of the lists that exist: created and not deleted since, and every user's favourites.

    A blank name becomes the default on create and changes nothing on rename; a rename of a list that doesn't exist
    does nothing. Creating the favourites, which exist, only names them.
    """
    at, name = F.struct("ts", "event_id"), F.trim("name")
    naming = events.where("op IN ('create', 'rename')").where((name != "") | ((F.col("op") == "create") & (F.col("list_id") != FAVOURITES)))
    # the last name of a list that exists was given at its creation or since
    named = naming.groupBy("user_id", "list_id").agg(F.max_by(F.when(name == "", NEW_NAME).otherwise(name), at).alias("name"))
    own = _lives(events).select("user_id", "list_id").unionByName(events.select("user_id").distinct().select("user_id", F.lit(FAVOURITES).alias("list_id")))
    return own.join(named, ["user_id", "list_id"], "left").select("user_id", "list_id", F.coalesce("name", F.lit(FAVOURITES_NAME)).alias("name"))


def lists_containing(member_rows: DataFrame, items: DataFrame) -> DataFrame:
    """STA06: the lists that hold any of the items."""
    return member_rows.join(items, ["user_id", "item_id"], "left_semi").select("user_id", "list_id", "item_id")


def share_list(member_rows: DataFrame, words: DataFrame, title: str, credit: str) -> DataFrame:
    """STA07: user_id, list_id, text: a title, a bullet for each item, newest first, and the credit."""
    rows = member_rows.join(words, "item_id")
    order = F.struct("added_at", (-F.col("item_id")).alias("i"), "word")
    items = F.array_join(F.transform(F.sort_array(F.collect_list(order), asc=False), lambda x: F.concat(F.lit("• "), x["word"])), "\n")
    return rows.groupBy("user_id", "list_id").agg(F.concat(F.lit(f"{title}\n\n"), items, F.lit(f"\n\n{credit}")).alias("text"))


def settings(events: DataFrame) -> DataFrame:
    """STA08: user_id, theme, font: each user's last values over the defaults; values that are null or no number for the font count as not set."""
    at = F.struct("ts", "event_id")
    last = lambda key, value: F.max_by(F.when(F.col("key") == key, value), F.when((F.col("key") == key) & value.isNotNull(), at))
    set_ = events.groupBy("user_id").agg(last("theme", F.col("value")).alias("theme"), last("font", F.col("value").try_cast("double")).alias("font"))
    return set_.select("user_id", F.coalesce("theme", F.lit("system")).alias("theme"), F.coalesce("font", F.lit(1.0)).alias("font"))


STATE_SCHEMA = "lists array<struct<id:string,name:string,items:array<struct<id:bigint,w:string,t:bigint>>>>, history array<struct<id:bigint,w:string,t:bigint>>, settings struct<theme:string,font:double>"


def load_state(df: DataFrame, json: str = "json") -> DataFrame:
    """SRC11: the saved state over the defaults; favourites come back if missing, what can't be read is all defaults."""
    s = F.from_json(F.col(json), STATE_SCHEMA)
    blank = F.from_json(F.lit(f'{{"lists":[{{"id":"{FAVOURITES}","name":"favourites","items":[]}}],"history":[],"settings":{{"theme":"system","font":1.0}}}}'), STATE_SCHEMA)
    kept = F.coalesce(s["lists"], blank["lists"])
    kept = F.when(F.exists(kept, lambda x: x["id"] == FAVOURITES), kept).otherwise(F.concat(blank["lists"], kept))
    style = F.struct(F.coalesce(s["settings"]["theme"], blank["settings"]["theme"]).alias("theme"), F.coalesce(s["settings"]["font"], blank["settings"]["font"]).alias("font"))
    return df.withColumns({"lists": kept, "history": F.coalesce(s["history"], blank["history"]), "settings": style})


def save_state(df: DataFrame) -> DataFrame:
    """SNK09: lists, history and settings as one JSON text."""
    return df.withColumn("json", F.to_json(F.struct("lists", "history", "settings")))
