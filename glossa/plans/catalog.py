"""The registered queries over the reference operators, with the same queries in SQL.

Documents stand for entries: the first two words are the headword, the text is the body. Parts stand for headwords,
events for the log of lists and history, pages for marked-up text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import markup as M
from glossa.functions import text as T
from glossa.operators import corpus, entries, headwords, index, meanings, state
from glossa.plans import sql as S
from glossa.sources import corpus_files, queries as query_sources, sql_dump
from glossa.sources.shared import materialised
from glossa.streaming.history import history_table, run_history

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: A table of texts in fewer files than there are cores is dealt out to all of them if it is no larger than this.
SPREAD_BYTES = 1 << 30
_TEXTS = ("documents", "pages")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return _spread(df) if name in _TEXTS else df


def _spread(df: DataFrame) -> DataFrame:
    """A small table of one or a few files, which one or a few tasks would read and work on, in as many parts as there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    word = F.array_join(F.slice(F.split(text, " "), 1, 2), " ")
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.collapse(word).alias("word"), F.lit("").alias("pron"), text.alias("body"))


#: D3 in SQL.
ENTRIES = f"""entries AS (
  SELECT doc_id AS id, {S.collapse("array_to_string(string_split(coalesce(text, ''), ' ')[1:2], ' ')")} AS word, '' AS pron, coalesce(text, '') AS body FROM documents
)"""


# --- normalising and tokenising -------------------------------------------------------------------------------------


@registered(f"SELECT doc_id, {S.spaced('text')} AS spaced FROM documents")
def normalize_spaced(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", T.normalize_spaced("text").alias("spaced"))


@registered(f"SELECT doc_id, list_aggregate(list_transform(string_split(text, chr(10)), lambda x: {S.spaced('x')}), 'string_agg', chr(10)) AS spaced FROM documents")
def normalize_lines(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", T.normalize_spaced("text", keep_newlines=True).alias("spaced"))


@registered(f"SELECT p_partkey, {S.compact('p_name')} AS compact FROM part")
def normalize_compact(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", T.normalize_compact("p_name").alias("compact"))


@registered(f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ts[i] AS token FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, {S.tokens('text')} AS ts FROM documents))")
def tokenize_explode(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select("doc_id", F.posexplode(T.tokenize("text")).alias("pos", "token"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@registered(f"SELECT p_partkey, array_to_string({S.starts_of('p_name')}, ',') AS starts FROM part")
def word_starts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", F.array_join(T.word_starts("p_name"), ",").alias("starts"))


@registered(
    f"""SELECT p_partkey, CAST(place - 1 AS BIGINT) AS place, CAST(CASE WHEN w = '' THEN 0 WHEN w IN ('red', 'bol', 'ge') THEN 2 WHEN starts_with(w, 'red') OR starts_with(w, 'bol') THEN 1 ELSE 0 END AS INTEGER) AS hit
    FROM (SELECT p_partkey, place, {S.compact("ws[place]")} AS w FROM (SELECT p_partkey, ws, unnest(range(1, len(ws) + 1)) AS place FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)))"""
)
def term_test(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("red", "bol", "ge")))
    words = _table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "w"))
    return words.select("p_partkey", F.col("place").cast("long").alias("place"), T.term_test("w", terms).cast("int").alias("hit"))


@registered(f"SELECT page_id, {S.persian_digits('translate(url, ' + S.quoted('0123456789') + ', ' + S.quoted(S.ARABIC_DIGITS) + ')')} AS digits FROM pages")
def persian_digits(spark: SparkSession, d: str) -> DataFrame:
    arabic = F.translate("url", "0123456789", T.ARABIC_DIGITS)
    return _table(spark, d, "pages").select("page_id", T.persian_digits(arabic).alias("digits"))


@registered(f"SELECT page_id, {S.decode_entities('html')} AS decoded FROM pages")
def decode_entities(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", T.decode_entities("html").alias("decoded"))


@registered(f"SELECT page_id, {S.collapse(S.persian_digits(S.decode_entities(S.strip_tags('html'))))} AS cleaned FROM pages")
def clean(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", T.clean("html").alias("cleaned"))


@registered(f"SELECT doc_id, {S.collapse('text')} AS head FROM documents")
def headword_clean(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", T.collapse("text").alias("head"))


# --- markup -----------------------------------------------------------------------------------------------------------


@registered(f"SELECT page_id, {S.strip_markup('html')} AS body FROM pages")
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", M.strip_markup("html").alias("body"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """An entry's source markup, made of a whole document."""
    docs = _table(spark, d, "documents")
    html = F.concat(
        F.lit('<span class="hlight">h</span> <font color="DarkGreen"><b>[ '), F.col("lang"), F.lit("٣ ]</font></b> "), F.replace("text", F.lit("\n"), F.lit("<br>")),
        F.lit('<br/><font color="Blue">◄</font> '), F.col("source"), F.lit(' <font color="Red">'), F.col("lang"), F.lit('<br>&amp;x</font>. <font color="HotPink">♦</font> <span class="hlight">phrase '),
        F.col("lang"), F.lit('</span> ؛ end <span class="hlight" dir="rtl">d</span>'),
    )
    return docs.select("doc_id", html.alias("html"))


_BODY = S.tidy(
    S.persian_digits(
        "' ' || text || chr(1) || ' ' || source || ' ' || chr(2) || lang || ' &x' || chr(3) || '. ' || chr(4) || ' ' || chr(5) || 'phrase ' || lang || chr(6) || ' ؛ end d'"
    )
)


@registered(f"SELECT doc_id, lang || '۳' AS pron, {_BODY} AS body, 'phrase ' || lang AS phrases FROM documents")
def convert_markup(spark: SparkSession, d: str) -> DataFrame:
    c = _marked(spark, d).withColumn("c", M.convert("html"))
    return c.select("doc_id", "c.pron", "c.body", F.array_join("c.phrases", "|").alias("phrases"))


_LONG_PHRASE = ("long " * 20).strip()
_BRANCH_BODY = S.tidy(
    f"' some body ' || chr(14) || 'in ' || lang || chr(15) || ' mid  --  x ' || chr(5) || '{_LONG_PHRASE}' || chr(6) || '؛ y ' || chr(5) || 'Dup ' || lang || chr(6) || '؛ ' || chr(5) || 'dup ' || upper(lang) || chr(6) || ' ؛ no ' || chr(5) || 'unlisted' || chr(6) || ', AB۰' || chr(8204) || '&bogus; &lt; ' || text"
)


@registered(f"SELECT doc_id, '' AS pron, {_BRANCH_BODY} AS body, 'Dup ' || lang || '|dup ' || upper(lang) AS phrases, 'Dup ' || lang AS kept FROM documents")
def convert_branches(spark: SparkSession, d: str) -> DataFrame:
    """Inline pronunciations, spans without letters, long, repeated and unlisted phrases, numeric and unknown entities."""
    lang = F.col("lang")
    html = F.concat(
        F.lit('<span class="hlight">h</span> some body <font color="DarkGreen"><b>[ in '), lang, F.lit(f' ]</font></b> mid <span class="hlight">--</span> x <span class="hlight">{_LONG_PHRASE}</span>؛ y <span class="hlight">Dup '),
        lang, F.lit('</span>؛ <span class="hlight"> dup  '), F.upper(lang), F.lit('</span> ؛ no <span class="hlight">unlisted</span>, &#65;&#x42;&#1632;&ZWNJ;&bogus; &amp;lt; '), F.replace("text", F.lit("\n"), F.lit("<br>")),
    )
    c = _table(spark, d, "documents").withColumn("c", M.convert(html))
    return c.select("doc_id", "c.pron", "c.body", F.array_join("c.phrases", "|").alias("phrases"), F.array_join(corpus.kept_phrases(F.col("c.phrases"), F.lit("h")), "|").alias("kept"))


@registered(f"SELECT doc_id, {S.plain_for_index(_BODY)} AS plain FROM documents")
def plain_for_index(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("doc_id", M.plain_for_index(M.convert("html")["body"]).alias("plain"))


@registered(f"SELECT doc_id, {S.collapse('regexp_replace(replace(replace(b, chr(1), ' + S.quoted(' ◄ ') + '), chr(4), ' + S.quoted(' ♦ ') + '), ' + S.quoted('[\\x00-\\x1f]') + ', ' + S.quoted(' ') + ', ' + S.quoted('g') + ')')} AS plain FROM (SELECT doc_id, {_BODY} AS b FROM documents)")
def plain_text(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("doc_id", M.plain_text(M.convert("html")["body"]).alias("plain"))


_MEANING = S.trim_wide("replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(b, chr(1), chr(10) || '• '), '\\x02([^\\x03]*)\\x03?', '— \\1', 'g'), chr(4), '♦ '), '[\\x00-\\x09\\x0b-\\x1f]', '', 'g'), '[ \\t]+', ' ', 'g'), chr(10) || ' ', chr(10))")


@registered(f"SELECT doc_id, m AS meaning, left(replace(m, chr(10), ' '), 300) AS preview FROM (SELECT doc_id, {_MEANING} AS m FROM (SELECT doc_id, {_BODY} AS b FROM documents))")
def meaning_text(spark: SparkSession, d: str) -> DataFrame:
    c = _marked(spark, d).select("doc_id", M.convert("html")["body"].alias("b"))
    return c.select("doc_id", M.meaning_text("b").alias("meaning"), M.preview("b").alias("preview"))


@registered(
    f"""SELECT doc_id, 'w [p]' || chr(10) || chr(10) || CASE WHEN length(m) > 3500 THEN regexp_replace(left(m, 3500), '[{S.WS}]+[^{S.WS}]*$', '') || ' …' ELSE m END || chr(10) || chr(10) || '— credit' AS shared
    FROM (SELECT doc_id, {_MEANING} AS m FROM (SELECT doc_id, {_BODY} AS b FROM documents))"""
)
def share_text(spark: SparkSession, d: str) -> DataFrame:
    c = _marked(spark, d).select("doc_id", M.convert("html")["body"].alias("b"))
    return c.select("doc_id", M.share_text(F.lit("w"), F.lit("p"), "b", "— credit", 3500).alias("shared"))


@registered("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", T.html_escape("html").alias("escaped"))


@registered(
    f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
      '\\x02([^\\x03]*)\\x03?', '<cite>\\1</cite>', 'g'), '\\x05([^\\x06]*)\\x06?', '<b class="hl">\\1</b>', 'g'), '\\x04', '<span class="sub">♦</span>', 'g') AS html
    FROM (SELECT doc_id, {_BODY} AS b FROM documents)"""
)
def render_inline(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("doc_id", M.render_inline(M.convert("html")["body"]).alias("html"))


def _inline(x: str) -> str:
    """A line's control characters as HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    for a, b, html in (("02", "03", "<cite>\\1</cite>"), ("05", "06", '<b class="hl">\\1</b>'), ("0e", "0f", '<span class="pron">[\\1]</span>')):
        x = f"regexp_replace({x}, '\\x{a}([^\\x{b}]*)\\x{b}?', '{html}', 'g')"
    return f"replace({x}, chr(4), '<span class=\"sub\">♦</span>')"


#: A line is verse where the next line that can't be one is a citation, eight lines further at most.
_VERSE = f"""lines AS (SELECT doc_id, i, ls[i] AS x FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
    SELECT doc_id, list_filter(string_split(replace(b, chr(1), chr(10) || chr(1)), chr(10)), lambda l: regexp_matches(l, '[^{S.WS}]')) AS ls FROM body))),
kinds AS (SELECT *, regexp_matches(x, '^\x02[^\x03]*\x03[{S.WS}.]*$') AS cite FROM lines),
stops AS (SELECT *, cite OR starts_with(x, chr(1)) OR contains(x, chr(4)) OR regexp_matches(x, '[:：][{S.WS}]*$') OR length(x) > 140 AS stop FROM kinds),
ends AS (SELECT *, arg_min(cite, i) FILTER (stop) OVER below AND min(i) FILTER (stop) OVER below - i <= 8 AND NOT stop AS v FROM stops
  WINDOW below AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
shown AS (SELECT doc_id, i, x, cite, coalesce(v, false) AS verse, coalesce(lag(coalesce(v, false)) OVER (PARTITION BY doc_id ORDER BY i), false) AS open FROM ends)"""


@registered(
    f"""WITH body AS (SELECT doc_id, {_BODY} AS b FROM documents), {_VERSE}
    SELECT doc_id, coalesce(html, CASE WHEN b IS NOT NULL THEN '' END) AS html FROM body LEFT JOIN (
      SELECT doc_id, string_agg(CASE WHEN verse AND NOT open THEN '<div class="verse">' ELSE '' END || CASE
        WHEN verse THEN '<p>' || {_inline("x")} || '</p>'
        WHEN open AND cite THEN {_inline("x")} || '</div>'
        WHEN starts_with(x, chr(1)) THEN '<p class="sense">' || {_inline("substring(x, 2)")} || '</p>'
        ELSE '<p>' || {_inline("x")} || '</p>' END, '' ORDER BY i) AS html FROM shown GROUP BY doc_id) USING (doc_id)"""
)
def render_meaning(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("doc_id", M.render_meaning(M.convert("html")["body"]).alias("html"))


_WORD_ENDS_SQL = S.WORD_ENDS.replace("'", "''")
_ESC = "replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_HIT = "regexp_matches(" + S.compact(f"replace(ws[i], {S.quoted(S.ZWNJ)}, '')") + ", '^(thing|que|der)')"


@registered(
    f"""SELECT conv_id, turn, list_aggregate(list_transform(range(1, len(gs) + 1), lambda i: {_ESC.format(x="gs[i]")} || CASE WHEN i > len(ws) THEN '' WHEN {_HIT} THEN '<mark>' || {_ESC.format(x="ws[i]")} || '</mark>' ELSE {_ESC.format(x="ws[i]")} END), 'string_agg', '') AS marked
    FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^{_WORD_ENDS_SQL}]+') AS ws, string_split_regex(text, '[^{_WORD_ENDS_SQL}]+') AS gs FROM conversations)"""
)
def mark_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("thing", "que", "der")))
    return _table(spark, d, "conversations").select("conv_id", "turn", T.mark_terms("text", terms).alias("marked"))


@registered("SELECT l_quantity AS n, translate(format('{:,}', CAST(l_quantity * 1000 AS BIGINT)), '0123456789,', '۰۱۲۳۴۵۶۷۸۹٬') AS shown FROM (SELECT DISTINCT l_quantity FROM lineitem)")
def persian_number(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "lineitem").select("l_quantity").distinct()
    return n.select(F.col("l_quantity").alias("n"), T.persian_number(F.col("l_quantity") * 1000).alias("shown"))


@registered("SELECT user_id, CASE WHEN n >= 30 THEN '+۳۰' ELSE translate(CAST(n AS VARCHAR), '0123456789', '۰۱۲۳۴۵۶۷۸۹') END AS shown FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def capped_count(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", T.capped_count("n", 30).alias("shown"))


# --- index -------------------------------------------------------------------------------------------------------------

_SEG = f"""{ENTRIES},
cut AS (SELECT id, string_split_regex({S.plain_for_index("replace(body, chr(1), '.')")}, '[.؛،:]') AS segs FROM entries),
seg AS (SELECT id, i, {S.tokens("segs[i]")} AS ts FROM (SELECT id, segs, unnest(range(1, len(segs) + 1)) AS i FROM cut)),
run AS (SELECT id, i, ts, coalesce(sum(len(ts)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seg),
syn AS (SELECT DISTINCT id, unnest(ts) AS token FROM run WHERE len(ts) BETWEEN 1 AND 2 AND before < 500),
tok AS (SELECT id, CAST(before + j - 1 AS BIGINT) AS pos, ts[j] AS token FROM (SELECT id, before, ts, unnest(range(1, len(ts) + 1)) AS j FROM run)),
stats AS (SELECT (SELECT count(*) FROM entries) AS n, (SELECT count(*) FROM tok) AS total_len),
len_ AS (SELECT id, count(*) AS len FROM tok GROUP BY id),
df AS (SELECT token, count(DISTINCT id) AS df FROM tok WHERE pos < 500 GROUP BY token),
stop AS (SELECT token FROM df, stats WHERE df > n * 6e-2),
tc AS (SELECT id, token, count(*) AS tf, min(pos) AS first_pos FROM tok WHERE pos < 500 GROUP BY id, token),
post AS (
  SELECT token, id, CAST(greatest(0, least(15, floor(log2(w * boost / 1e-1) * CAST(1.95 AS DOUBLE)))) AS INTEGER) AS q FROM (
    SELECT tc.token, tc.id,
      (tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + (CAST(0.75 AS DOUBLE) * len) / (total_len / n))) AS w,
      (1 + 3 / (1 + first_pos / 6)) * CASE WHEN syn.token IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(2.5 AS DOUBLE) END AS boost
    FROM tc JOIN len_ USING (id) CROSS JOIN stats LEFT JOIN syn ON syn.id = tc.id AND syn.token = tc.token
    WHERE tc.token NOT IN (SELECT token FROM stop)
  )
)"""


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    return index.segments(_entries(spark, d))


@registered(f"WITH {_SEG} SELECT e.id, coalesce(l.len, 0) AS len, coalesce(s.syn, '') AS syn FROM entries e LEFT JOIN len_ l USING (id) LEFT JOIN (SELECT id, string_agg(token, ' ' ORDER BY token) AS syn FROM syn GROUP BY id) s USING (id)")
def segments_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return _segmented(spark, d).select("id", F.size("tokens").cast("long").alias("len"), F.array_join(F.array_sort("syn"), " ").alias("syn"))


@registered(f"WITH {_SEG} SELECT id, pos, token FROM tok")
def token_positions(spark: SparkSession, d: str) -> DataFrame:
    return index.token_positions(_segmented(spark, d))


@registered(f"WITH {_SEG} SELECT n, total_len, total_len / n AS avg_len FROM stats")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.corpus_stats(_segmented(spark, d))


@registered(f"WITH {_SEG} SELECT token, df FROM df")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return index.doc_freq(_segmented(spark, d))


@registered(f"WITH {_SEG} SELECT token FROM stop")
def stopwords(spark: SparkSession, d: str) -> DataFrame:
    s = _segmented(spark, d)
    return index.stopwords(index.doc_freq(s), index.corpus_stats(s))


@registered(f"WITH {_SEG} SELECT tc.id, tc.token, tf, first_pos, len, syn.token IS NOT NULL AS is_syn FROM tc JOIN len_ USING (id) LEFT JOIN syn ON syn.id = tc.id AND syn.token = tc.token")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.term_counts(_segmented(spark, d))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """stats, stopwords, postings, vocabulary."""
    s = materialised(_segmented(spark, d))
    stats = materialised(index.corpus_stats(s))
    stop = materialised(index.stopwords(index.doc_freq(s), stats))
    post = materialised(index.postings(s, stats, stop))
    return stats, stop, post, materialised(index.vocabulary(post))


@registered(f"WITH {_SEG} SELECT token, id, q FROM post")
def postings_q(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)[2]


@registered(f"WITH {_SEG} SELECT token, count(*) AS df FROM post GROUP BY token")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)[3]


@registered("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ch")
def char_frequency(spark: SparkSession, d: str) -> DataFrame:
    return corpus_files.char_frequency(_table(spark, d, "documents"), "text")


# --- headword search ---------------------------------------------------------------------------------------------------

HEAD_QUERIES = ("red", "hot gear", "hotgear", "gear", "wid", "RED  widget", "dwid", "t b", "smallring", "ol", "economy", "omy", "g", "r", "", "?!", "all promo", "lr")
_HEAD_Q = "q(query_id, q) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {S.quoted(q)})" for i, q in enumerate(HEAD_QUERIES)) + ")"
_HEADS = f"""{_HEAD_Q},
heads AS (
  SELECT kind, line, display, {S.compact("display")} AS c, {S.starts_of("display")} AS st FROM (
    SELECT 'entry' AS kind, p_partkey AS line, p_name AS display FROM part UNION ALL SELECT 'phrase', p_partkey, p_type || ' ' || p_brand FROM part)
),
qs AS (SELECT query_id, {S.compact("q")} AS qc, {S.starts_of("q")} AS br FROM q WHERE {S.compact("q")} <> ''),
occ AS (
  SELECT query_id, kind, line, display, c, st, qc, br, unnest(range(0, length(c) - length(qc) + 1)) AS p
  FROM qs JOIN heads ON length(qc) > 1 AND contains(c, qc)
),
ok AS (
  SELECT query_id, kind, line, display,
    CASE WHEN p = 0 AND length(c) = length(qc) THEN 0 WHEN p = 0 THEN 1 WHEN list_contains(st, p) THEN 2 ELSE 3 END AS tier
  FROM occ WHERE substring(c, CAST(p AS INTEGER) + 1, length(qc)) = qc AND (
    len(list_filter(st, lambda s: s > p AND s < p + length(qc) AND NOT list_contains(br, s - p))) = 0
    OR p = 0 OR (list_contains(st, p) AND (list_contains(st, p + length(qc)) OR p + length(qc) = length(c))))
),
one AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY line) AS place
  FROM qs JOIN heads ON length(qc) = 1 AND starts_with(c, qc)
),
hits AS (
  SELECT query_id, kind, line, display, min(tier) AS tier FROM ok GROUP BY ALL
  UNION ALL SELECT query_id, kind, line, display, CASE WHEN length(c) = 1 THEN 0 ELSE 1 END FROM one WHERE place <= 400
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, kind = 'phrase', line) AS rank FROM hits)"""


def _heads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = _table(spark, d, "part")
    words = corpus.headword_list(part, "p_partkey", "p_name", "entry")
    phrases = part.select(F.col("p_partkey").alias("phrase_id"), F.concat_ws(" ", "p_type", "p_brand").alias("phrase"), F.col("p_partkey").alias("parent_id"))
    return words.unionByName(corpus.headword_list(phrases, "phrase_id", "phrase", "phrase")), phrases, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("word"))


def _queries(spark: SparkSession, texts: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, q string")


@registered(f"WITH {_HEADS} SELECT query_id, rank, line AS id, display AS w, CAST(tier AS INTEGER) AS tier, kind = 'phrase' AS is_phrase, CASE WHEN kind = 'phrase' THEN p_name END AS parent FROM ranked LEFT JOIN part ON p_partkey = line WHERE rank <= 400")
def headword_search(spark: SparkSession, d: str) -> DataFrame:
    heads, phrases, words = _heads(spark, d)
    return headwords.search_headwords(heads, _queries(spark, HEAD_QUERIES), phrases, words)


@registered(f"WITH {_HEADS} SELECT query_id, kind, line, CAST(tier AS INTEGER) AS tier FROM hits")
def headword_matches_by_gram(spark: SparkSession, d: str) -> DataFrame:
    """The same matches by the way for large batches: an equal join on two-letter grams."""
    return headwords.matches(_heads(spark, d)[0], _queries(spark, HEAD_QUERIES), broadcast_limit=0).select("query_id", "kind", "line", F.col("tier").cast("int").alias("tier"))


@registered(f"WITH {_HEADS} SELECT query_id, kind, line, CAST(tier AS INTEGER) AS tier FROM hits")
def headword_matches_by_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same matches by the way for small batches: the queries are sent to the headwords."""
    return headwords.matches(_heads(spark, d)[0], _queries(spark, HEAD_QUERIES), broadcast_limit=100).select("query_id", "kind", "line", F.col("tier").cast("int").alias("tier"))


@registered(f"""SELECT e.event_id AS query_id, p.p_partkey AS id FROM (SELECT event_id, {S.compact("props")} AS c FROM events) e JOIN (SELECT p_partkey, '{{k: ' || p_partkey || '}}' AS name FROM part) p ON {S.compact("p.name")} = c""")
def typed_queries(spark: SparkSession, d: str) -> DataFrame:
    """Typed texts as queries: each event's text is looked up among the parts' keys."""
    typed = query_sources.query_texts(_table(spark, d, "events"), "event_id", "props")
    names = _table(spark, d, "part").select("p_partkey", F.concat(F.lit("{k: "), "p_partkey", F.lit("}")).alias("name"))
    return headwords.lookup(corpus.headword_list(names, "p_partkey", "name", "entry"), typed)


@registered(f"WITH {_HEADS} SELECT query_id, line AS id FROM qs JOIN heads ON kind = 'entry' AND c = qc")
def headword_lookup(spark: SparkSession, d: str) -> DataFrame:
    return headwords.lookup(_heads(spark, d)[0], _queries(spark, HEAD_QUERIES))


@registered(f"WITH q AS (SELECT {S.compact(S.quoted('T B'))} AS qc) SELECT p_partkey, CASE WHEN strpos(replace(p_name, ' ', ''), qc) = 0 THEN p_name ELSE regexp_replace(p_name, 't ?b', '<b>\\0</b>') END AS html FROM part, q")
def highlight_query(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", T.highlight_query("p_name", F.lit("T B")).alias("html"))


@registered(
    """SELECT page_id, CASE WHEN regexp_matches(url, '[?&]ref=[^&#]') THEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) END AS q, regexp_extract(url, '[?&]page=([^&#]*)', 1) = '1' AS go FROM pages"""
)
def deep_link(spark: SparkSession, d: str) -> DataFrame:
    url = F.replace(F.replace("url", F.lit("ref="), F.lit("q=")), F.lit("page="), F.lit("go="))
    q, go = query_sources.deep_link(url)
    return _table(spark, d, "pages").select("page_id", q.alias("q"), go.alias("go"))


@registered(f"WITH {_HEADS} SELECT query_id, arg_min(line, rank) AS id FROM ranked WHERE tier = 0 AND kind = 'entry' AND query_id % 2 = 0 AND rank <= 400 GROUP BY query_id")
def deep_link_choice(spark: SparkSession, d: str) -> DataFrame:
    heads, phrases, words = _heads(spark, d)
    hits = headwords.search_headwords(heads, _queries(spark, HEAD_QUERIES), phrases, words)
    links = spark.range(len(HEAD_QUERIES)).select(F.col("id").alias("query_id"), (F.col("id") % 2 == 0).alias("go"))
    return query_sources.chosen(hits, links)


# --- full-text search --------------------------------------------------------------------------------------------------

TEXT_QUERIES = ("stupid thing", "apache license version", "erin", "thin", "queelle", "nosuchword trash", "of the", "scum disgusting worthless", "anea erin that", "x", "email zzzqqq", "erthing erhanea einchein", "licensed under")
_TEXT_Q = "q(query_id, q) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {S.quoted(q)})" for i, q in enumerate(TEXT_QUERIES)) + ")"


def _meaning_sql(exclude: str) -> str:
    return f"""WITH {_SEG}, {_TEXT_Q},
qt AS (SELECT query_id, term, min(i) AS i FROM (SELECT query_id, ts[i] AS term, i FROM (SELECT query_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT query_id, {S.tokens("q")} AS ts FROM q))) GROUP BY ALL),
terms AS (SELECT * FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY i) AS ord FROM qt WHERE term NOT IN (SELECT token FROM stop)) WHERE ord <= 6),
voc AS (SELECT token, count(*) AS df FROM post GROUP BY token),
ex AS (SELECT DISTINCT term, token, CAST(1 AS DOUBLE) AS weight, df FROM terms JOIN voc ON token = term),
pr AS (
  SELECT term, token, CAST(0.55 AS DOUBLE) AS weight, df FROM (
    SELECT term, token, df, row_number() OVER (PARTITION BY term ORDER BY df DESC, token) AS place
    FROM (SELECT DISTINCT term FROM terms WHERE length(term) >= 3) JOIN voc ON starts_with(token, term) AND token <> term
  ) WHERE place <= 300
),
both_ AS (SELECT * FROM ex UNION ALL SELECT * FROM pr),
tdf AS (SELECT term, coalesce(max(df) FILTER (weight = 1), least(any_value(n), sum(df) FILTER (weight < 1))) AS d FROM both_, stats GROUP BY term),
idf AS (SELECT term, ln(1 + (n - d + CAST(0.5 AS DOUBLE)) / (d + CAST(0.5 AS DOUBLE))) AS idf FROM tdf, stats),
best AS (
  SELECT query_id, ord, id, max(weight * CAST(0.1 AS DOUBLE) * pow(CAST(2 AS DOUBLE), (q + CAST(0.5 AS DOUBLE)) / CAST(1.95 AS DOUBLE))) * any_value(idf) AS s
  FROM terms JOIN both_ USING (term) JOIN idf USING (term) JOIN post USING (token) GROUP BY ALL
),
need AS (SELECT query_id, count(DISTINCT ord) AS need FROM terms JOIN both_ USING (term) GROUP BY query_id),
acc AS (SELECT query_id, id, round(list_sum(list(s ORDER BY ord)), 9) AS score, count(*) AS hits FROM best GROUP BY ALL),
kept AS (SELECT *, max(CAST(hits = need AS INTEGER)) OVER (PARTITION BY query_id) AS whole FROM acc JOIN need USING (query_id) WHERE {exclude}),
res AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM kept WHERE whole = 0 OR hits = need),
fin AS (SELECT query_id, res.id, word, total, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(word), res.id) AS rank FROM res JOIN entries ON entries.id = res.id)
SELECT query_id, rank, id, word AS w, total FROM fin WHERE rank <= 1000"""


def _meanings(spark: SparkSession, d: str, exclude: DataFrame | None = None) -> DataFrame:
    stats, stop, post, voc = _index(spark, d)
    return meanings.search_meanings(voc, post, stop, stats, _entries(spark, d).select("id", "word"), _queries(spark, TEXT_QUERIES), exclude)


@registered(_meaning_sql("true"))
def meaning_search(spark: SparkSession, d: str) -> DataFrame:
    return _meanings(spark, d)


@registered(_meaning_sql("id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def meaning_search_exclude(spark: SparkSession, d: str) -> DataFrame:
    """Without labelled entries: AND falls back to OR where all full matches are left out."""
    out = _table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    q = spark.range(len(TEXT_QUERIES)).select(F.col("id").alias("query_id"))
    return _meanings(spark, d, out.withColumn("query_id", F.explode(F.sequence(F.lit(0), F.lit(len(TEXT_QUERIES) - 1)))).withColumn("query_id", F.col("query_id").cast("long")).join(q, "query_id", "left_semi"))


@registered(
    _meaning_sql("true").replace("SELECT query_id, rank, id, word AS w, total FROM fin WHERE rank <= 1000", """SELECT q.query_id, coalesce(t.terms, '') AS terms, CASE WHEN t.terms IS NOT NULL THEN coalesce(f.total, 0) END AS total
    FROM q LEFT JOIN (SELECT query_id, string_agg(term, ' ' ORDER BY ord) AS terms FROM terms GROUP BY query_id) t USING (query_id) LEFT JOIN (SELECT query_id, max(total) AS total FROM fin GROUP BY query_id) f USING (query_id)""")
)
def meaning_summary(spark: SparkSession, d: str) -> DataFrame:
    """What each query asked for and how much it found, also where that is nothing."""
    stats, stop, post, voc = _index(spark, d)
    asked = _queries(spark, TEXT_QUERIES)
    found = meanings.search_meanings(voc, post, stop, stats, _entries(spark, d).select("id", "word"), asked)
    return meanings.query_summary(asked, stop, found).select("query_id", F.array_join("terms", " ").alias("terms"), "total")


@registered(f"WITH {_HEADS} SELECT DISTINCT query_id, line AS id FROM ranked WHERE rank <= 400 AND tier <= 1 AND kind = 'entry'")
def shown_headwords(spark: SparkSession, d: str) -> DataFrame:
    heads, phrases, words = _heads(spark, d)
    return meanings.shown_headwords(headwords.search_headwords(heads, _queries(spark, HEAD_QUERIES), phrases, words))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked full-text search of a batch of queries."""
    return _meanings(spark, sf_dir)


# --- entries -------------------------------------------------------------------------------------------------------------


@registered(f"WITH {ENTRIES} SELECT i.id, e.word, e.pron, e.body, p.word AS prev, n.word AS next FROM (SELECT DISTINCT doc_id * 7 AS id FROM labels) i LEFT JOIN entries e ON e.id = i.id LEFT JOIN entries p ON p.id = i.id - 1 LEFT JOIN entries n ON n.id = i.id + 1")
def entry_lookup(spark: SparkSession, d: str) -> DataFrame:
    return entries.entries_by_id(_entries(spark, d), _table(spark, d, "labels").select((F.col("doc_id") * 7).alias("id")))


@registered(f"WITH {ENTRIES} SELECT id, word, pron, body FROM entries WHERE id IS NOT NULL ORDER BY md5('11:' || CAST(id AS VARCHAR)), id LIMIT 1")
def random_entry(spark: SparkSession, d: str) -> DataFrame:
    return entries.random_entry(_entries(spark, d), 11)


_PLAIN = S.collapse("regexp_replace(body, '[\\x00-\\x1f]', ' ', 'g')")


@registered(f"WITH {ENTRIES} SELECT id, pron, CASE WHEN length(t) > 160 THEN regexp_replace(left(t, 160), '[{S.WS}]+[^{S.WS}]*$', '') || ' …' ELSE t END AS text FROM (SELECT id, pron, {_PLAIN} AS t FROM entries)")
def snippet_start(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return entries.snippets(e, e.select("id"), [])


_SNIPPET_AT = f"""SELECT id, pron, t, coalesce(min(CASE WHEN k = 2 THEN pos_ END), min(CASE WHEN k = 1 THEN pos_ END), -1) AS place FROM (
  SELECT id, pron, t, pos_, CASE WHEN c = 'thing' OR c = 'qu' THEN 2 WHEN starts_with(c, 'thing') THEN 1 ELSE 0 END AS k FROM (
    SELECT id, pron, t, {S.compact("w")} AS c, sum(length(w) + length(g)) OVER (PARTITION BY id ORDER BY i) - length(w) AS pos_ FROM (
      SELECT id, pron, t, i, ws[i] AS w, gs[i] AS g FROM (
        SELECT id, pron, t, ws, gs, unnest(range(1, greatest(len(ws), 1) + 1)) AS i FROM (
          SELECT id, pron, t, regexp_extract_all(t, '[^{S.WORD_ENDS.replace("'", "''")}]+') AS ws, string_split_regex(t, '[^{S.WORD_ENDS.replace("'", "''")}]+') AS gs
          FROM (SELECT id, pron, {_PLAIN} AS t FROM entries))))))
  GROUP BY id, pron, t"""


@registered(
    f"""WITH {ENTRIES}, a AS ({_SNIPPET_AT}),
    f AS (SELECT *, left(t, CAST(place - 40 + 1 AS INTEGER)) AS head FROM a),
    s AS (SELECT id, pron, t, CASE WHEN place <= 40 THEN left(t, 160) ELSE '… ' || substring(t, CASE WHEN contains(head, ' ') THEN length(head) - strpos(reverse(head), ' ') + 1 ELSE 0 END + 1, 160) END AS s FROM f)
    SELECT id, pron, CASE WHEN length(s) < length(t) THEN regexp_replace(s, '[{S.WS}]+[^{S.WS}]*$', '') || ' …' ELSE s END AS text FROM s"""
)
def snippet_term(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return entries.snippets(e, e.select("id"), ["thing", "qu"])


@registered(
    f"""WITH {_SEG} SELECT 'entries' AS artefact, (SELECT count(*) FROM entries) AS n_rows UNION ALL SELECT 'phrases', 0 UNION ALL SELECT 'headwords', (SELECT count(*) FROM entries)
    UNION ALL SELECT 'postings', (SELECT count(*) FROM post) UNION ALL SELECT 'vocabulary', (SELECT count(DISTINCT token) FROM post) UNION ALL SELECT 'stopwords', (SELECT count(*) FROM stop) UNION ALL SELECT 'corpus_stats', 1"""
)
def build_report(spark: SparkSession, d: str) -> DataFrame:
    """Builds, saves and loads a corpus, and reports its tables."""
    from glossa.sources.shared import shared_dir

    stats, stop, post, voc = _index(spark, d)
    e = _entries(spark, d)
    none = spark.createDataFrame([], "phrase_id long, phrase string, parent_id long")
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    corpus_files.Corpus(e, none, corpus.headword_list(e, "id", "word", "entry"), post, voc, stop, stats).save(path)
    return corpus_files.Corpus.load(spark, path).report()


# --- dumps -----------------------------------------------------------------------------------------------------------------

_ROWS = "SELECT p_partkey, p_brand || '''s' AS word, p_name || chr(10) || '\"x\\y\"' AS meaning FROM part"


def _dump(spark: SparkSession, d: str) -> DataFrame:
    """Part rows as INSERT statements of 100 rows."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    part = _table(spark, d, "part")
    row = F.concat(F.lit("("), F.col("p_partkey"), F.lit(", '"), escape(F.concat("p_brand", F.lit("'s"))), F.lit("', '"), escape(F.concat("p_name", F.lit('\n"x\\y"'))), F.lit("')"))
    rows = part.select((F.col("p_partkey") / 100).cast("int").alias("s"), F.struct("p_partkey", row.alias("r")).alias("r")).groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["r"]), ",\n").alias("rows"))
    return rows.select(F.concat(F.lit("-- head (a, b)\nCREATE TABLE `w` (\n `id` int(255) NOT NULL);\nINSERT INTO `w` (`id`, `word`, `meaning`) VALUES\n"), "rows", F.lit(";\n")).alias("value"), F.concat(F.lit("f"), "s").alias("file"))


@registered(f"SELECT CAST(p_partkey AS INTEGER) AS source_id, word, meaning, 'f' || CAST(p_partkey // 100 AS VARCHAR) AS file, p_partkey % 100 AS at FROM ({_ROWS})")
def sql_dump_rows(spark: SparkSession, d: str) -> DataFrame:
    return sql_dump.parse_dump(_dump(spark, d))


@registered(f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, CAST(p_partkey AS INTEGER) AS source_id, word, replace(meaning, chr(10), chr(10)) AS body FROM ({_ROWS})")
def dump_entries(spark: SparkSession, d: str) -> DataFrame:
    return corpus.entries_from_rows(sql_dump.parse_dump(_dump(spark, d))).select("id", "source_id", "word", "body")


def _dump_files(spark: SparkSession, d: str) -> str:
    """A folder of dump files, some with a tuple to a line as usual."""
    from glossa.sources.shared import shared_dir

    path = f"{shared_dir(spark)}/dumps-{uuid.uuid4().hex}"
    _dump(spark, d).select("value").write.option("lineSep", "\n").text(path)
    return path


_FILE_ROWS = f"SELECT CAST(p_partkey AS INTEGER) AS source_id, word, meaning FROM ({_ROWS})"


@registered(_FILE_ROWS)
def dump_files(spark: SparkSession, d: str) -> DataFrame:
    """Dump files on disk, read whole."""
    return sql_dump.read_dumps(spark, _dump_files(spark, d)).select("source_id", "word", "meaning")


@registered(f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, CAST(p_partkey AS INTEGER) AS source_id, word, meaning AS body FROM ({_ROWS})")
def dump_files_by_line(spark: SparkSession, d: str) -> DataFrame:
    """Dump files read by line, split between tasks; the rows keep their order."""
    return corpus.entries_from_rows(sql_dump.read_dumps(spark, _dump_files(spark, d), whole=False)).select("id", "source_id", "word", "body")


@registered("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS phrase_id, 'phrase ' || lang AS phrase, row_number() OVER (ORDER BY doc_id) - 1 AS parent_id FROM documents")
def dump_phrases(spark: SparkSession, d: str) -> DataFrame:
    rows = _marked(spark, d).select(F.col("doc_id").cast("int").alias("source_id"), F.lit("h").alias("word"), F.col("html").alias("meaning"), F.lit("f").alias("file"), F.lit(0).cast("long").alias("at"))
    return corpus.phrases_of(corpus.entries_from_rows(rows))


# --- keyed state -------------------------------------------------------------------------------------------------------------

_LOG = """log AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 4 = 0 THEN 'fav' ELSE 'l' || CAST(event_id % 3 AS VARCHAR) END AS list_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id,
  CASE WHEN event_id % 19 = 1 THEN 'create' WHEN event_id % 71 = 2 THEN 'delete' WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'clear' ELSE 'toggle' END AS op FROM events)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.col("event_id")
    op = F.when(id_ % 19 == 1, "create").when(id_ % 71 == 2, "delete").when(F.col("event_type") == "error", "remove").when((F.col("event_type") == "signup") & (id_ % 5 == 0), "clear").otherwise("toggle")
    list_id = F.when(id_ % 4 == 0, "fav").otherwise(F.concat(F.lit("l"), id_ % 3))
    e = _table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", list_id.alias("list_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("item_id"), op.alias("op"))


_HISTORY = "SELECT user_id, item_id, ts, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS n FROM {log}) WHERE n = 1) WHERE rank <= {k}"


@registered(f"WITH {_LOG} " + _HISTORY.format(log="log", k=40))
def history_top40(spark: SparkSession, d: str) -> DataFrame:
    return state.history(_log(spark, d))


@registered(f"WITH {_LOG} " + _HISTORY.format(log="log", k=40))
def history_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same view kept up by a stream of the events."""
    from glossa.sources.shared import shared_dir

    at = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    arrived = _table(spark, d, "events")
    arrived.repartition(4, "event_id").write.parquet(f"{at}/arriving")
    events = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/arriving")
    item = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    run_history(events.select("event_id", "ts", "user_id", item.alias("item_id")), f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return history_table(spark, f"{at}/rows/*")


@registered(f"WITH {_LOG} " + _HISTORY.format(log="log", k=24))
def history_strip(spark: SparkSession, d: str) -> DataFrame:
    return state.history(_log(spark, d), state.STRIP)


@registered(f"WITH {_LOG}, c AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS e, max(ts) AS t FROM log WHERE op = 'clear' GROUP BY user_id) " + _HISTORY.format(log="(SELECT log.* FROM log LEFT JOIN c USING (user_id) WHERE op <> 'clear' AND (e IS NULL OR ts > t OR (ts = t AND event_id > e)))", k=40))
def history_cleared(spark: SparkSession, d: str) -> DataFrame:
    return state.history(state.after_clear(_log(spark, d)))


#: Walks along each list's events: which life of the list an event falls into, and whether the list exists then.
_MEMBERS = """walk AS (
  SELECT *, list_id = 'fav' OR coalesce(last_value(CASE WHEN op IN ('create', 'delete') THEN op END IGNORE NULLS) OVER along = 'create', false) AS exists_,
    CASE WHEN list_id = 'fav' THEN 0 ELSE count(*) FILTER (op IN ('create', 'delete')) OVER along END AS life
  FROM log WINDOW along AS (PARTITION BY user_id, list_id ORDER BY ts, event_id)
),
lives AS (SELECT user_id, list_id, max(life) AS life FROM walk GROUP BY ALL),
steps AS (
  SELECT *, count(*) FILTER (op = 'remove') OVER (PARTITION BY user_id, list_id, item_id ORDER BY ts, event_id) AS removes, count(*) FILTER (op = 'remove') OVER (PARTITION BY user_id, list_id, item_id) AS all_removes
  FROM walk JOIN lives USING (user_id, list_id, life) WHERE exists_ AND op IN ('toggle', 'remove')
),
mem AS (SELECT user_id, list_id, item_id, max(ts) AS added_at FROM steps WHERE op = 'toggle' AND removes = all_removes GROUP BY ALL HAVING count(*) % 2 = 1)"""


@registered(f"WITH {_LOG}, {_MEMBERS} SELECT * FROM mem")
def toggle_membership(spark: SparkSession, d: str) -> DataFrame:
    return state.members(_log(spark, d))


@registered(f"WITH {_LOG}, {_MEMBERS} SELECT user_id, list_id, item_id FROM mem")
def lists_containing(spark: SparkSession, d: str) -> DataFrame:
    asked = _log(spark, d).select("user_id", "item_id").distinct()
    return state.lists_containing(state.members(_log(spark, d)), asked)


@registered(f"WITH {_LOG}, {_MEMBERS} SELECT user_id, list_id, 'mine' || chr(10) || chr(10) || string_agg('• ' || p_name, chr(10) ORDER BY added_at DESC, item_id, p_name DESC) || chr(10) || chr(10) || '— credit' AS text FROM mem JOIN part ON p_partkey = item_id GROUP BY user_id, list_id")
def list_share_text(spark: SparkSession, d: str) -> DataFrame:
    words = _table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("word"))
    return state.share_list(state.members(_log(spark, d)), words, "mine", "— credit")


_ADMIN = """adm AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 11 = 0 THEN 'fav' ELSE 'l' || CAST(event_id % 4 AS VARCHAR) END AS list_id,
  CASE event_id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'rename' ELSE 'delete' END AS op, CASE WHEN event_id % 7 < 2 THEN '  ' ELSE ' n' || CAST(event_id % 13 AS VARCHAR) || ' ' END AS name FROM events)"""


@registered(
    f"""WITH {_ADMIN}, walk AS (
      SELECT *, last_value(CASE WHEN op <> 'rename' THEN op END IGNORE NULLS) OVER along AS state, count(*) FILTER (op <> 'rename') OVER along AS life, row_number() OVER along AS place
      FROM adm WHERE list_id <> 'fav' WINDOW along AS (PARTITION BY user_id, list_id ORDER BY ts, event_id)
    ),
    ends AS (SELECT user_id, list_id, max(life) AS life FROM walk GROUP BY ALL),
    names AS (SELECT user_id, list_id, arg_max(CASE WHEN trim(name) = '' THEN 'new list' ELSE trim(name) END, place) AS name FROM walk JOIN ends USING (user_id, list_id, life)
      WHERE state = 'create' AND (op = 'create' OR trim(name) <> '') GROUP BY ALL),
    favs AS (SELECT user_id, 'fav' AS list_id, coalesce(arg_max(trim(name), (ts, event_id)) FILTER (list_id = 'fav' AND op <> 'delete' AND trim(name) <> ''), 'favourites') AS name FROM adm GROUP BY user_id)
    SELECT * FROM names UNION ALL SELECT * FROM favs"""
)
def list_admin(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    id_ = F.col("event_id")
    list_id = F.when(id_ % 11 == 0, "fav").otherwise(F.concat(F.lit("l"), id_ % 4))
    op = F.when(id_ % 3 == 0, "create").when(id_ % 3 == 1, "rename").otherwise("delete")
    name = F.when(id_ % 7 < 2, "  ").otherwise(F.concat(F.lit(" n"), id_ % 13, F.lit(" ")))
    return state.lists(e.select("event_id", "ts", "user_id", list_id.alias("list_id"), op.alias("op"), name.alias("name")))


_SETTINGS = "CASE WHEN event_type = 'click' THEN 'theme' ELSE 'font' END AS key, CASE WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' END WHEN event_id % 9 < 3 THEN 'x' ELSE CAST(event_id % 5 AS VARCHAR) END AS value"


@registered(
    f"""WITH s AS (SELECT event_id, ts, user_id, {_SETTINGS} FROM events WHERE event_type IN ('click', 'purchase')),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, event_id DESC) AS n FROM s WHERE value IS NOT NULL AND (key = 'theme' OR value <> 'x'))
    SELECT u.user_id, coalesce(t.value, 'system') AS theme, coalesce(CAST(f.value AS DOUBLE), 1) AS font FROM (SELECT DISTINCT user_id FROM s) u
    LEFT JOIN r t ON t.user_id = u.user_id AND t.key = 'theme' AND t.n = 1 LEFT JOIN r f ON f.user_id = u.user_id AND f.key = 'font' AND f.n = 1"""
)
def settings(spark: SparkSession, d: str) -> DataFrame:
    e, id_ = _table(spark, d, "events").where("event_type IN ('click', 'purchase')"), F.col("event_id")
    click = F.col("event_type") == "click"
    value = F.when(click, F.when(id_ % 3 == 0, "dark").when(id_ % 3 == 1, "light")).when(id_ % 9 < 3, "x").otherwise((id_ % 5).cast("string"))
    return state.settings(e.select("event_id", "ts", "user_id", F.when(click, "theme").otherwise("font").alias("key"), value.alias("value")))


@registered(
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'fav' WHEN event_id % 4 = 2 THEN 'fav,b' ELSE 'fav' || CASE WHEN event_id % 4 = 1 THEN ',c' ELSE '' END END AS list_ids,
    CASE WHEN event_id % 4 = 1 THEN 'dark' ELSE 'system' END AS theme, CAST(CASE WHEN event_id % 4 = 2 THEN 1 ELSE 0 END AS BIGINT) AS n_history FROM events"""
)
def state_load(spark: SparkSession, d: str) -> DataFrame:
    """Saved states of four kinds: nothing, favourites beside another list, favourites missing, unreadable."""
    kinds = ['{"lists":null}', '{"lists":[{"id":"fav","name":"f","items":[]},{"id":"c","name":"c","items":[]}],"settings":{"theme":"dark"}}', '{"lists":[{"id":"b","name":"b","items":[]}],"history":[{"id":1,"w":"w","t":5}]}', "{broken"]
    e = _table(spark, d, "events").select("event_id", F.array(*map(F.lit, kinds))[(F.col("event_id") % 4).cast("int")].alias("json"))
    s = state.load_state(state.save_state(state.load_state(e)).select("event_id", "json"))
    return s.select("event_id", F.array_join(F.transform("lists", lambda x: x["id"]), ",").alias("list_ids"), F.col("settings.theme").alias("theme"), F.size("history").cast("long").alias("n_history"))
