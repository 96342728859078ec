from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glossa.functions import markup as M
from glossa.operators.corpus import entries_from_rows, phrases_of
from glossa.sources.sql_dump import parse_dump, read_dumps


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("r")).head()["r"]


HTML = (
    '<span class="hlight">w.</span> <font color="DarkGreen"><b>[ <i>pr</i>٣ ]</font></b> body &amp;amp; <br/>l2 <BR><font color="Blue">◄</font> s2 '
    '<font color="Red">Poet<br>X</font>. <font color="HotPink"> ♦ </font> <span class="hlight">phrase one</span> ؛ m <span class="hlight">--</span> '
    '<span class="hlight" dir="rtl">d</span><font color="DarkGreen"><b>[in]</font></b> (short note) <span class="hlight">no phrase</span>, z'
)


def test_convert(spark):
    c = one(spark, M.convert("x"), HTML)
    assert c["pron"] == "pr۳"
    assert c["phrases"] == ["phrase one"]
    assert c["body"] == "body &amp;\nl2\x01s2\x02Poet X\x03.\x04\x05phrase one\x06؛ m -- d\x0ein\x0f (short note)\x05no phrase\x06, z"


def test_convert_without_marks(spark):
    assert one(spark, M.convert("x"), "plain")["body"] == "plain"
    assert one(spark, M.convert("x"), "") ["body"] == ""
    assert one(spark, M.convert("x"), "<!-- c --><script>x</script>")["body"] == "<!-- c -->x"


def test_views(spark):
    body = "a\x01b\x02Poet\x03.\x04\x05p\x06 (n) x\x0ei\x0f"
    assert one(spark, M.plain_text("x"), body) == "a ◄ b Poet . ♦ p (n) x i"
    assert one(spark, M.meaning_text("x"), body) == "a\n• b— Poet.♦ p (n) x[i]"
    assert one(spark, M.plain_for_index("x"), body).split() == ["a", "b", ".", "p", "x", "i"]
    assert one(spark, M.render_inline("x"), "<\x02c") == "&lt;<cite>c</cite>"


def test_verse(spark):
    body = "intro:\nv1\nv2 & x\n\x02Poet\x03.\nafter\n\x01sense\x05p\x06\nl\n\x02C\x03"
    assert one(spark, M.render_meaning("x"), body) == (
        '<p>intro:</p><div class="verse"><p>v1</p><p>v2 &amp; x</p><cite>Poet</cite>.</div><p>after</p><p class="sense">sense<b class="hl">p</b></p><div class="verse"><p>l</p><cite>C</cite></div>'
    )
    ten = "\n".join(f"v{i}" for i in range(10)) + "\n\x02P\x03"
    assert one(spark, M.render_meaning("x"), ten).startswith('<p>v0</p><p>v1</p><div class="verse"><p>v2</p>')
    assert "verse" not in one(spark, M.render_meaning("x"), "x" * 141 + "\n\x02P\x03")


def test_share_text(spark):
    assert one(spark, M.share_text(F.lit("w"), F.lit(""), "x", "c", 7), "ab cd ef") == "w\n\nab cd …\n\nc"


DUMP = r"""CREATE TABLE `t` (`id` int(255) NOT NULL, `a` text, `b` text);
INSERT INTO `t` (`id`, `word`, `meaning`) VALUES
(2, 'it''s', 'a \"q\" \\ \n(1, 2, 3) \x'),
(1, 'b ; c', '<span class=\"hlight\">ph</span>; x');
insert into t values (3,'',NULL) , (1, 'dup', 'z');
"""


def test_dump_rows(spark, tmp_path):
    (tmp_path / "b.sql").write_text(DUMP, encoding="utf-8")
    (tmp_path / "a.sql").write_text("INSERT INTO `t` VALUES (9, 'x', 'y');", encoding="utf-8")
    rows = {(r["file"], r["at"]): (r["source_id"], r["word"], r["meaning"]) for r in read_dumps(spark, str(tmp_path)).collect()}
    assert rows[("b.sql", 0)] == (2, "it's", 'a "q" \\ \n(1, 2, 3) x')
    assert rows[("b.sql", 1)] == (1, "b ; c", '<span class="hlight">ph</span>; x')
    assert rows[("b.sql", 2)] == (3, "", "NULL") and rows[("b.sql", 3)] == (1, "dup", "z")
    assert rows[("a.sql", 0)] == (9, "x", "y") and len(rows) == 5
    by_line = read_dumps(spark, str(tmp_path), whole=False)
    assert sorted(r["source_id"] for r in by_line.collect()) == [1, 1, 2, 3, 9]


@pytest.mark.parametrize(
    "broken",
    [
        "INSERT INTO t VALUES oops;", "INSERT INTO t VALUES (1, 'a', 'b'), (2, NOW(), 'x');", "INSERT INTO t VALUES (1, 'a', 'b'), (2, 'open", "INSERT INTO t VALUES (1, 'a', 'b') (2, 'c', 'd');",
        "INSERT INTO t VALUES (1, 'a', 'b')", "INSERT INTO t VALUES (1, 'a' 'b', 'c');", "INSERT INTO t VALUES (1, 'a', 'b'),\n(2, 'two');", "INSERT INTO t VALUES (1, 'a', 'b'),;", "INSERT INTO t (a, b)",
    ],
)
def test_broken_statements_fail(spark, broken):
    for text in (broken, "-- head (1, 'x', 'y');\nINSERT INTO t VALUES (7, 'g', 'h');\n" + broken):
        with pytest.raises(Exception, match=r"breaks off in f|fewer than three values in f"):
            parse_dump(spark.createDataFrame([(text, "f")], "value string, file string")).collect()


def test_only_tuples_of_statements_are_rows(spark, tmp_path):
    text = "CREATE TABLE t (\n  a int(11),\n  KEY k (a,b,c)\n) ENGINE=x;\nINSERT INTO t (a, b, c) VALUES\n(1, 'VALUES (3, ''x'', ''y'')', 'INSERT INTO t VALUES (4, 5, 6);'),\n  (2,  ,NULL)   ,\n(3, '', '')             ;\nALTER TABLE t ADD (x,y,z);\n"
    want = [(1, "VALUES (3, 'x', 'y')", "INSERT INTO t VALUES (4, 5, 6);"), (2, "", "NULL"), (3, "", "")]
    got = parse_dump(spark.createDataFrame([(text, "f")], "value string, file string")).orderBy("at").collect()
    assert [tuple(r)[2:] for r in got] == want
    (tmp_path / "a.sql").write_text(text, encoding="utf-8")
    lines = read_dumps(spark, str(tmp_path), whole=False).orderBy("file", "block", "line", "at")
    assert [(r["source_id"], r["word"], r["meaning"]) for r in lines.collect()] == want
    (tmp_path / "b.sql").write_text("INSERT INTO t VALUES\n(1, 'a', 'raw\nbreak');\n", encoding="utf-8")
    with pytest.raises(Exception, match="breaks off in b.sql"):
        read_dumps(spark, str(tmp_path), whole=False).collect()
    assert read_dumps(spark, f"{tmp_path}/b.sql").head()["meaning"] == "raw\nbreak"


def test_equal_ids_keep_their_order_by_line(spark, tmp_path):
    rows = [(i % 3, f"w{i}") for i in range(4000)]
    (tmp_path / "a.sql").write_text("INSERT INTO t VALUES\n" + ",\n".join(f"({i}, '{w}', 'm')" for i, w in rows) + ";\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = read_dumps(spark, str(tmp_path), whole=False)
        assert lines.rdd.getNumPartitions() > 5
        got = entries_from_rows(lines).orderBy("id").select("source_id", "word").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in got] == sorted(rows, key=lambda r: r[0])


def test_entries_are_dense_and_phrases_keep_the_first_spelling(spark):
    p = lambda t: f'<span class="hlight">{t}</span>؛ '
    rows = [(7, "b", "x", "f", 0), (3, " a  w ", p("a w") + p("Ph one") + p("ph  ONE") + p("!!") + p("two"), "f", 1), (3, "dup", "y", "f", 2)]
    e = entries_from_rows(spark.createDataFrame(rows, "source_id int, word string, meaning string, file string, at long"))
    assert [(r["id"], r["word"]) for r in e.orderBy("id").collect()] == [(0, "a w"), (1, "dup"), (2, "b")]
    assert [(r["phrase_id"], r["phrase"], r["parent_id"]) for r in phrases_of(e).orderBy("phrase_id").collect()] == [(0, "Ph one", 0), (1, "two", 0)]
