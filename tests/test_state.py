from __future__ import annotations

import datetime as dt

from glossa.operators import state
from glossa.streaming.history import history_table, run_history

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, list_id string, item_id long, op string"


def log(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i), 1, "fav", item, op) for i, (item, op) in enumerate(rows)], SCHEMA)


def test_history_keeps_the_latest_40_once_each(spark):
    pushes = [i % 43 for i in range(45)]
    rows = state.history(log(spark, [(i, "push") for i in pushes])).orderBy("rank").collect()
    assert [r["item_id"] for r in rows] == [1, 0, *range(42, 4, -1)]


def test_clear(spark):
    events = log(spark, [(1, "push"), (0, "clear"), (2, "push")])
    assert [r["item_id"] for r in state.history(state.after_clear(events)).collect()] == [2]


def test_toggles_after_the_last_remove_count(spark):
    events = log(spark, [(1, "toggle"), (1, "remove"), (1, "toggle"), (2, "toggle"), (2, "toggle"), (3, "toggle"), (3, "remove")])
    assert [r["item_id"] for r in state.members(events).collect()] == [1]


def test_lists(spark):
    rows = [(0, "a", "create", " "), (1, "a", "rename", "  "), (2, "b", "create", "x"), (3, "b", "delete", ""), (4, "fav", "create", "F"), (5, "fav", "delete", "")]
    events = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i), 1, l, op, n) for i, l, op, n in rows], "event_id long, ts timestamp, user_id long, list_id string, op string, name string")
    assert sorted((r["list_id"], r["name"]) for r in state.lists(events).collect()) == [("a", "new list"), ("fav", "F")]


def test_state_survives_saving_and_broken_text_gives_defaults(spark):
    rows = spark.createDataFrame([('{"lists":[{"id":"x","name":"n","items":[{"id":1,"w":"w","t":2}]}]}',), ("{",), (None,)], "json string")
    s = state.load_state(rows)
    again = state.load_state(state.save_state(s).select("json"))
    for r in (s, again):
        assert [[x["id"] for x in y["lists"]] for y in r.collect()] == [["fav", "x"], ["fav"], ["fav"]]


def test_share_list(spark):
    m = state.members(log(spark, [(1, "toggle"), (2, "toggle")]))
    words = spark.createDataFrame([(1, "one"), (2, "two")], "item_id long, word string")
    assert state.share_list(m, words, "t", "c").head()["text"] == "t\n\n• two\n• one\n\nc"


def test_stream(spark, tmp_path):
    log(spark, [(1, "push"), (2, "push"), (1, "push")]).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    run_history(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["item_id"] for r in history_table(spark, str(tmp_path / "out")).orderBy("rank").collect()] == [1, 2]


def list_log(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i), 1, *r) for i, r in enumerate(rows)], "event_id long, ts timestamp, user_id long, list_id string, op string, name string, item_id long")


def test_lists_that_were_deleted_dont_come_back_by_renaming(spark):
    rows = [("a", "rename", "early", 0), ("a", "create", "one", 0), ("a", "delete", "", 0), ("a", "rename", "two", 0), ("b", "create", "b1", 0), ("b", "rename", " b2 ", 0), ("c", "create", "c1", 0), ("c", "delete", "", 0), ("c", "create", "", 0)]
    got = sorted((r["list_id"], r["name"]) for r in state.lists(list_log(spark, rows)).collect())
    assert got == [("b", "b2"), ("c", "new list"), ("fav", "favourites")]


def test_items_live_and_go_with_their_list(spark):
    rows = [("a", "toggle", "", 1), ("a", "create", "x", 0), ("a", "toggle", "", 1), ("a", "toggle", "", 2), ("a", "delete", "", 0), ("a", "toggle", "", 3), ("a", "create", "y", 0), ("a", "toggle", "", 2), ("fav", "toggle", "", 9), ("b", "toggle", "", 4), ("fav", "delete", "", 0)]
    got = sorted((r["list_id"], r["item_id"]) for r in state.members(list_log(spark, rows)).collect())
    assert got == [("a", 2), ("fav", 9)]
