from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossa.functions import text as T


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("r")).head()["r"]


def test_letters_of_both_scripts_are_one(spark):
    assert one(spark, T.normalize_spaced("x"), "كي  A,bé É") == "کی a bé É"
    assert one(spark, T.normalize_compact("x"), "ء") == ""
    assert one(spark, T.normalize_spaced("x"), "٤۵") == "45"


def test_non_joiner_joins_in_tokens_and_separates_in_spaced(spark):
    word = "می‌رود"
    assert one(spark, T.tokenize("x"), word) == [word.replace("‌", "")]
    assert one(spark, T.normalize_spaced("x"), word) == word.replace("‌", " ")
    assert one(spark, T.tokenize("x"), "a bc, \U0001f600 d") == ["bc"]


def test_lines_are_kept(spark):
    assert one(spark, T.normalize_spaced(F.col("x"), True), " a \n\n b ") == "a\n\nb"


def test_word_starts(spark):
    assert one(spark, T.word_starts("x"), " ab  cd-e ") == [0, 2, 4]
    assert one(spark, T.word_starts("x"), "") == []


def test_entities_are_decoded_once(spark):
    assert one(spark, T.decode_entities("x"), "&amp;lt; &#38;gt; &#x41; &LT; &foo; &#xD800; &#12f; &#1740; &") == "&lt; &gt; A < &foo; &#xD800; &#12f; ی &"


def test_clean_and_escape(spark):
    assert one(spark, T.clean("x"), "<b>a \n&amp;</b>٣ <3") == "a &۳ <3"
    assert one(spark, T.html_escape("x"), '<&">') == "&lt;&amp;&quot;&gt;"


def test_term_test(spark):
    terms = F.array(F.lit("foo"), F.lit("ba"))
    assert [one(spark, T.term_test(F.lit(w), terms)) for w in ("Foo", "food", "bar", "ba", "", "!")] == [2, 1, 0, 2, 0, 0]


def test_snippet_shapes(spark):
    terms = F.array(F.lit("target"))
    text = "word " * 20 + "target " + "more " * 60
    near, far, last, none = ("target " + text, text.strip(), "word " * 20 + "target", "short")
    assert one(spark, T.snippet("x", terms), near).startswith("target word")
    cut = one(spark, T.snippet("x", terms), far)
    assert cut.startswith("… word") and cut.endswith(" …") and "target" in cut and len(cut) <= 164
    assert one(spark, T.snippet("x", terms), last).endswith("word …")  # the last word goes although the text ends there
    assert one(spark, T.snippet("x", terms), none) == "short"


def test_exact_term_beats_earlier_prefix(spark):
    assert one(spark, T.find_term("x", F.array(F.lit("foo"), F.lit("bar"))), "a foobar, bar") == 10
    assert one(spark, T.find_term("x", F.array(F.lit("foo"))), "a foobar, bar") == 2
    assert one(spark, T.find_term("x", F.array(F.lit("zzz"))), "a foobar") == -1


def test_terms_are_found_in_normalised_words(spark):
    terms = F.array(*map(F.lit, ("thing", "qu", "a.c", "", "Big", "کتاب")))
    texts = {"a TH-I_N\u00adG b": 2, "\U0001f600\U0001f600 thing": 3, "x\u001fqu": 2, "quit, things qu": 13, "quit some things": 10, "abc -- d": 4, "ABig big a.c": -1, "یک كتاب": 3, "": -1, "(thing)": 1}
    assert {x: one(spark, T.find_term("x", terms), x) for x in texts} == texts


def test_a_text_is_normalised_a_few_times_only(spark):
    """Whatever a snippet needs of it."""
    plan = spark.createDataFrame([("",)], "x string").select(T.snippet(T.collapse("x"), F.array(F.lit("target"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(x#") == 1


def test_white_space_becomes_one_space(spark):
    text = "\u3000a  b\t\u2003c\u2003d e\u200bf\u2fff g\u00a0\n"
    assert one(spark, T.collapse("x"), text) == "a b c d e\u200bf\u2fff g"


def test_highlight_keeps_marks_inside(spark):
    q = F.lit("كb")
    assert one(spark, T.highlight_query("x", q), "xکَbَ <c>") == "x<b>کَbَ</b> &lt;c&gt;"
    assert one(spark, T.highlight_query("x", F.lit("zz")), "a<") == "a&lt;"
    assert one(spark, T.highlight_query("x", F.lit("ab")), "a b c") == "<b>a b</b> c"


def test_mark_terms(spark):
    assert one(spark, T.mark_terms("x", F.array(F.lit("foo"))), "a food, fo & foo") == "a <mark>food</mark>, fo &amp; <mark>foo</mark>"


LETTERS = st.text(alphabet="aB كيء‌,.\néَ1١", max_size=20)


@settings(max_examples=5, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=30))
def test_normalising_is_idempotent(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(T.normalize_spaced("x").alias("s"), T.normalize_compact("x").alias("c"))
    rows = rows.withColumns({"again": T.normalize_spaced("s"), "compact": T.normalize_compact("s")})
    for r in rows.collect():
        assert r["s"] == r["again"] and r["c"] == r["compact"] and " " not in r["c"]
