from __future__ import annotations

import pytest

from glossa.operators import corpus, entries, headwords, index, meanings
from glossa.sources.corpus_files import Corpus
from glossa.sources.queries import chosen, deep_link


def heads(spark, words, phrases=()):
    w = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    p = spark.createDataFrame([(i, t, parent) for i, (t, parent) in enumerate(phrases)], "phrase_id long, phrase string, parent_id long")
    return corpus.headword_list(w, "id", "word", "entry").unionByName(corpus.headword_list(p, "phrase_id", "phrase", "phrase")), p, w


def find(spark, q, words, phrases=(), **more):
    h, p, w = heads(spark, words, phrases)
    rows = headwords.search_headwords(h, spark.createDataFrame([(0, q)], "query_id long, q string"), p, w).orderBy("rank").collect()
    return [(r["id"], r["w"], r["tier"]) for r in rows]


def test_tiers(spark):
    words = ["yad", "yadgar", "sang yad", "az yad bordan", "any adx", "zyadx"]
    assert find(spark, "yad", words) == [(0, "yad", 0), (1, "yadgar", 1), (2, "sang yad", 2), (3, "az yad bordan", 2), (5, "zyadx", 3)]


def test_joined_query_and_other_script(spark):
    assert find(spark, "yadavar", ["yad avar"]) == [(0, "yad avar", 0)]
    assert find(spark, "كتابي", ["کتابی"])[0][2] == 0
    assert find(spark, "?!", ["a"]) == []


def test_single_letter_takes_the_first_400_lines_only(spark):
    words = [f"b{i}" for i in range(400)] + ["b"]
    hits = find(spark, "b", words)
    assert len(hits) == 400 and all(t == 1 for _, _, t in hits)


def test_phrases_come_behind_entries_of_their_tier(spark):
    assert find(spark, "red", ["blue", "red"], [("red", 0)]) == [(1, "red", 0), (0, "red", 0)]


def test_both_ways_of_matching_agree(spark):
    h, _, _ = heads(spark, ["aba ba", "ab ab", "bab", "ba", "a", "x"])
    q = spark.createDataFrame(list(enumerate(["ab", "a b", "bab", "a", "aba"])), "query_id long, q string")
    near, far = headwords.matches(h, q), headwords.matches(h, q, broadcast_limit=0)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))


def test_common_grams_are_split(spark, monkeypatch):
    monkeypatch.setattr(headwords, "GRAM_ROWS", 3)
    h, _, _ = heads(spark, [f"abab{i}cd" for i in range(40)] + ["ab", "xy", "ba ab", "a b"])
    q = spark.createDataFrame(list(enumerate(["ab", "bab", "b1", "zz", "abz", "ab ab", "5cd"])), "query_id long, q string")
    near, far = headwords.matches(h, q, broadcast_limit=100), headwords.matches(h, q, broadcast_limit=0)
    rows = sorted(map(tuple, far.collect()))
    assert sorted(map(tuple, near.collect())) == rows and len({r[0] for r in rows}) == 5


def build(spark, bodies, share=0.06):
    e = spark.createDataFrame([(i, f"w{i}", "", b) for i, b in enumerate(bodies)], "id long, word string, pron string, body string")
    s = index.segments(e)
    stats = index.corpus_stats(s)
    stop = index.stopwords(index.doc_freq(s), stats, share)
    post = index.postings(s, stats, stop)
    return e, stats, stop, post, index.vocabulary(post)


def search(spark, built, q, exclude=None):
    e, stats, stop, post, voc = built
    out = meanings.search_meanings(voc, post, stop, stats, e, spark.createDataFrame([(0, q)], "query_id long, q string"), exclude)
    return [(r["id"], r["total"]) for r in out.orderBy("rank").collect()]


def test_counts_of_an_entry_are_made_where_its_tokens_are(spark):
    """The shuffle moves entries, not their tokens one by one, and nothing is sorted."""
    bodies = ["aa bb. aa; cc dd ee. x. a-a\u200cb: ZZ zz", "", "x. y", "bb"]
    e = spark.createDataFrame([*enumerate(bodies), (3, "bb cc dd ee ff"), (None, "gg gg")], "id long, body string")
    terms = index.term_counts(index.segments(e))
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "posexplode" in plan[: plan.index("Exchange")]
    rows = sorted((tuple(r[c] for c in ("id", "token", "tf", "first_pos", "len", "is_syn")) for r in terms.collect()), key=repr)
    of_0 = [(0, "aa", 2, 0, 9, True), (0, "ab", 1, 6, 9, True), (0, "bb", 1, 1, 9, True), (0, "cc", 1, 3, 9, False), (0, "dd", 1, 4, 9, False), (0, "ee", 1, 5, 9, False), (0, "zz", 2, 7, 9, True)]
    assert [r for r in rows if r[0] == 0] == of_0
    assert [r[1:3] for r in rows if r[0] == 3] == [("bb", 2), ("cc", 1), ("dd", 1), ("ee", 1), ("ff", 1)] and rows[-1][:3] == (None, "gg", 2)


def test_stopwords_only_count_the_entries(spark, monkeypatch):
    heads_, head = [], type(spark.range(1)).head
    monkeypatch.setattr(type(spark.range(1)), "head", lambda self, *a: heads_.append(self._jdf.queryExecution().optimizedPlan().toString()) or head(self, *a))
    s = index.segments(spark.createDataFrame([(i, "aa bb") for i in range(3)], "id long, body string"))
    assert sorted(r["token"] for r in index.stopwords(index.doc_freq(s), index.corpus_stats(s)).collect()) == ["aa", "bb"]
    assert "translate" not in heads_[0]


@pytest.fixture(scope="module")
def built(spark):
    pad = "filler{0} other{0} more{0} text{0}"
    bodies = ["yad " + pad.format(0), "yadgar " + pad.format(1), "none " + pad.format(2), "moon sun " + pad.format(3), "moon sky " + pad.format(4), "sun sea " + pad.format(5)]
    return build(spark, bodies, share=0.9)


def test_prefix_counts_less_than_the_word(spark, built):
    assert search(spark, built, "yad") == [(0, 2), (1, 2)]


def test_all_terms_before_any(spark, built):
    assert search(spark, built, "moon sun") == [(3, 1)]
    out = spark.createDataFrame([(0, 3)], "query_id long, id long")
    assert sorted(search(spark, built, "moon sun", out)) == [(4, 2), (5, 2)]
    assert search(spark, built, "moon nosuchword") == [(3, 2), (4, 2)] or search(spark, built, "moon nosuchword") == [(4, 2), (3, 2)]
    assert search(spark, built, "x y") == []


def test_scores_fall_with_position_and_rise_alone(spark):
    early, late = "key " + "a1 " * 30, "a1 " * 30 + "key"
    _, _, _, post, _ = build(spark, [early, late, "a1 " * 15 + ". key . " + "a1 " * 15, "key key key " + "a1 " * 28], share=2.0)
    q = {r["id"]: r["q"] for r in post.where("token = 'key'").collect()}
    assert q[0] > q[1] and q[3] >= q[0] and q[2] > q[1] and all(0 <= x <= 15 for x in q.values())


def test_stopwords_hold_their_positions(spark):
    s = index.segments(spark.createDataFrame([(0, "aa bb c aa")], "id long, body string"))
    assert [(r["pos"], r["token"]) for r in index.token_positions(s).orderBy("pos").collect()] == [(0, "aa"), (1, "bb"), (2, "aa")]


def test_only_the_first_500_tokens_are_indexed_but_all_count(spark):
    s = index.segments(spark.createDataFrame([(0, "aa " * 500 + "zz")], "id long, body string"))
    assert index.corpus_stats(s).head()["total_len"] == 501
    assert [r["token"] for r in index.doc_freq(s).collect()] == ["aa"]


def test_entries(spark):
    e = spark.createDataFrame([(i, f"w{i}", "", f"body {i}") for i in range(3)], "id long, word string, pron string, body string")
    got = {r["id"]: (r["word"], r["prev"], r["next"]) for r in entries.entries_by_id(e, spark.createDataFrame([(0,), (2,), (9,)], "id long")).collect()}
    assert got == {0: ("w0", None, "w1"), 2: ("w2", "w1", None), 9: (None, None, None)}
    assert entries.random_entry(e, 5).collect() == entries.random_entry(e, 5).collect()


def test_corpus_is_saved_and_loaded(spark, tmp_path):
    e, stats, stop, post, voc = build(spark, ["one two", "two three"], share=2.0)
    p = spark.createDataFrame([], "phrase_id long, phrase string, parent_id long")
    Corpus(e, p, corpus.headword_list(e, "id", "word", "entry"), post, voc, stop, stats).save(str(tmp_path / "c"))
    loaded = Corpus.load(spark, str(tmp_path / "c")).cache()
    assert {r["artefact"]: r["n_rows"] for r in loaded.report().collect()} == {"entries": 2, "phrases": 0, "headwords": 2, "postings": 4, "vocabulary": 3, "stopwords": 0, "corpus_stats": 1}


def test_links(spark):
    rows = spark.createDataFrame([("yx://s?q=a%20b&go=1",), ("#/?go=0&q=",), ("x",)], "u string")
    q, go = deep_link(rows["u"])
    assert [tuple(r) for r in rows.select(q, go).collect()] == [("a b", True), (None, False), (None, False)]
    hits = spark.createDataFrame([(0, 1, 5, 0, True), (0, 2, 6, 0, False), (0, 3, 7, 1, False)], "query_id long, rank long, id long, tier int, is_phrase boolean")
    links = spark.createDataFrame([(0, True)], "query_id long, go boolean")
    assert [r["id"] for r in chosen(hits, links).collect()] == [6]


def test_summary_tells_nothing_found_from_nothing_asked(spark):
    words, stats, stop, post, voc = build(spark, ["alpha beta", "alpha gamma", "delta"], share=0.5)
    q = spark.createDataFrame(list(enumerate(["beta gamma", "nothing here", "a", "", "alpha"])), "query_id long, q string")
    found = meanings.search_meanings(voc, post, stop, stats, words, q)
    got = {r["query_id"]: (r["terms"], r["total"]) for r in meanings.query_summary(q, stop, found).collect()}
    assert got == {0: (["beta", "gamma"], 2), 1: (["nothing", "here"], 0), 2: ([], None), 3: ([], None), 4: ([], None)}
