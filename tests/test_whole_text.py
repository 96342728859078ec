"""Registered queries over whole tables, against their SQL on a small fixture."""

from __future__ import annotations

import duckdb
import pytest

from glossa.plans import catalog

NAMES = ("convert_markup", "plain_for_index", "plain_text", "meaning_text", "share_text", "render_inline", "dump_phrases")
TEXTS = ["short", "", "\n".join(f"line {i} of (a) text, 12 words: or so" for i in range(200)), "word " * 2000 + "last", "a\n\n\n b \t c " * 50 + "end"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "en", f"source{i}", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def sql_of(d, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    return con.sql(catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", NAMES)
def test_whole_documents(spark, tables, name):
    theirs = sql_of(tables, name)
    mine = catalog.queries()[name](spark, tables).select(*theirs.columns)
    assert sorted(map(tuple, mine.collect())) == sorted(theirs.fetchall())


def test_ends_of_documents_stay(spark, tables):
    html = {r["doc_id"]: r["html"] for r in catalog.queries()["render_meaning"](spark, tables).collect()}
    assert html[2].count("<p>line ") == 200 and "word last" in html[3]
    shared = {r["doc_id"]: r["shared"] for r in catalog.queries()["share_text"](spark, tables).collect()}
    assert 3490 < len(shared[3]) < 3540 and shared[0].count("short") == 1


def test_letters_of_empty_and_missing_texts(spark, tmp_path):
    texts = ["ab a", "", "", None, "e\u0301\r\n", "\U0001f468\u200d\U0001f469", " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    theirs = sql_of(str(tmp_path), "char_frequency")
    mine = catalog.queries()["char_frequency"](spark, str(tmp_path)).select(*theirs.columns)
    assert sorted(map(tuple, mine.collect())) == sorted(theirs.fetchall())


def test_lists_of_every_item_of_the_log(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02}", i % 3, "click", 1.0, f"item {i % 7}") for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", events.ts.cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    members = catalog.queries()["toggle_membership"](spark, str(tmp_path)).select("user_id", "list_id", "item_id").collect()
    found = catalog.queries()["lists_containing"](spark, str(tmp_path)).select("user_id", "list_id", "item_id").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, members)) and any((r["item_id"] - r["user_id"]) % 10 for r in found)
