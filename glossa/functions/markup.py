r"""Markup of entry bodies: from HTML to control characters, and from there to text and HTML again.

Control characters: \n line, 01 sense, 02..03 citation, 04 sub-entry, 05..06 phrase, 0e..0f inline pronunciation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.text import BLANK_LETTERS, TAG, WIDE_SPACE, Text, _c, clean, collapse, decode_entities, html_escape, once, persian_digits, replace_each

# The markup of source entries and the control characters it becomes.
BR = "(?i)<br[WS]*/?>".replace("WS", WIDE_SPACE)
PRON = '<font color="DarkGreen"><b>([\\s\\S]*?)</font></b>'
SENSE = f'(?i)(?:<br[{WIDE_SPACE}]*/?>[{WIDE_SPACE}]*)?<font color="Blue">◄</font>'
SUB = f'<font color="HotPink">[{WIDE_SPACE}]*♦[{WIDE_SPACE}]*</font>'
CITE = '<font color="Red">([\\s\\S]*?)</font>'
PHRASE = '<span class="hlight">([^<]*)</span>'
MAX_PHRASE, PHRASE_AHEAD = 70, 8


def trim_wide(s: Text) -> Column:
    return F.trim(_c(s), F.lit(BLANK_LETTERS))


def _pron(inner: Column) -> Column:
    bare = F.regexp_replace(clean(inner), f"^\\[[{WIDE_SPACE}]*|[{WIDE_SPACE}]*\\]\\z", "")
    return trim_wide(bare)


def strip_tags(s: Text) -> Column:
    """A tag begins with a letter; comments and the text of scripts stay."""
    return F.regexp_replace(_c(s), TAG, "")


def strip_markup(s: Text) -> Column:
    """CNV08, CNV09: line breaks, other tags gone, entities, Persian digits, white space in order."""
    s = F.regexp_replace(_c(s), BR, "\n")
    return tidy(persian_digits(decode_entities(strip_tags(s))))


def tidy(s: Column) -> Column:
    """CNV09: single blanks; one line break with nothing around it; nothing around sense marks, no blanks around the other marks."""
    s = F.regexp_replace(s, "[\\t\\r\\u00a0][ \\t\\r\\u00a0]*+| [ \\t\\r\\u00a0]++", " ")
    s = F.regexp_replace(s, " ?\\n[ \\n]*+", "\n")
    s = F.regexp_replace(s, "[ \\n]?\\x01[ \\n]?", "\u0001")
    return trim_wide(F.regexp_replace(s, " ?([\\x02-\\x06]) ?", "$1"))


def convert(html: Text) -> Column:
    """CNV01-09: struct of pron, body and phrases (as written, in order, repeats included)."""
    lead = f"^([\\s\\S]{{0,7}}?){PRON}"
    inline = lambda p: F.when(p != "", F.concat(F.lit("\u000e"), p, F.lit("\u000f"))).otherwise(" ")

    def led(m: Column) -> Column:
        """The pronunciation in front and the rest, with marks for all but phrases."""
        own = F.when(m.rlike(lead), _pron(F.regexp_extract(m, lead, 2))).otherwise("")
        rest = replace_each(F.regexp_replace(m, lead, "$1 "), PRON, lambda x: once(_pron(x), inline), mark='DarkGreen')
        rest = F.regexp_replace(rest, SENSE, "\u0001")
        rest = F.regexp_replace(rest, SUB, "\u0004")
        rest = replace_each(rest, CITE, lambda x: F.concat(F.lit("\u0002"), clean(F.regexp_replace(x, BR, " ")), F.lit("\u0003")), mark='"Red"')
        rest = F.regexp_replace(rest, '<span class="hlight" dir="[a-z]+">([^<]*)</span>', "$1")
        return F.struct(own.alias("p"), rest.alias("m"))

    def marked(x: Column) -> Column:
        """x: p, between (the texts around the phrases) and inner (the phrases)."""
        words = "[\\p{L}\\p{N}]"
        shown = F.transform(x["inner"], lambda t: F.when(t.rlike(words), F.concat(F.lit("\u0005"), t, F.lit("\u0006"))).otherwise(F.concat(F.lit(" "), t, F.lit(" "))))
        text = F.array_join(F.zip_with(x["between"], shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        listed = lambda t, i: t.rlike(words) & F.length(t).between(2, MAX_PHRASE) & F.substring(F.get(x["between"], i + 1), 1, PHRASE_AHEAD).rlike(f"^[{WIDE_SPACE}]*؛")
        return F.struct(persian_digits(x["p"]).alias("pron"), strip_markup(text).alias("body"), F.filter(x["inner"], listed).alias("phrases"))

    def parted(x: Column) -> Column:
        inner = F.transform(F.regexp_extract_all(x["m"], F.lit(PHRASE), F.lit(1)), clean)
        return F.struct(x["p"].alias("p"), F.split(x["m"], PHRASE, -1).alias("between"), inner.alias("inner"))

    # each value is computed once: what a function is given stands for it wherever it is used
    m = F.regexp_replace(_c(html), f'^[{WIDE_SPACE}]*<span class="hlight">[^<]*</span>', "")
    return once(m, lambda m: once(led(m), lambda x: once(parted(x), marked)))


def plain_for_index(body: Text) -> Column:
    """CNV11: without citations and short parentheticals, control characters as spaces."""
    s = F.regexp_replace(_c(body), "\\x02[^\\x03]*\\x03", " ")
    s = F.regexp_replace(s, "\\([^()\\n]{0,40}\\)", " ")
    return F.regexp_replace(s, "[\\x00-\\x1f]", " ")


def plain_text(body: Text) -> Column:
    """TXT01."""
    s = F.replace(_c(body), F.lit("\u0001"), F.lit(" ◄ "))
    s = F.replace(s, F.lit("\u0004"), F.lit(" ♦ "))
    return collapse(F.regexp_replace(s, "[\\x00-\\x1f]", " "))


def meaning_text(body: Text) -> Column:
    """TXT05: readable text with bullets, citations behind a dash, pronunciations in brackets."""
    s = F.replace(_c(body), F.lit("\u0001"), F.lit("\n• "))
    s = F.regexp_replace(s, "\\x02([^\\x03]*)\\x03?", "— $1")
    s = F.regexp_replace(s, "\\x0e([^\\x0f]*)\\x0f?", "[$1]")
    s = F.replace(s, F.lit("\u0004"), F.lit("♦ "))
    s = F.regexp_replace(s, "[\\x00-\\x09\\x0b-\\x1f]", "")
    s = F.replace(F.regexp_replace(s, "\\t[ \\t]*+| [ \\t]++", " "), F.lit("\n "), F.lit("\n"))
    return trim_wide(s)


def preview(body: Text, size: int = 300) -> Column:
    """TXT10."""
    return F.substring(F.replace(meaning_text(body), F.lit("\n"), F.lit(" ")), 1, size)


def share_text(word: Text, pron: Text, body: Text, credit: str, limit: int | None = None) -> Column:
    """SNK10: headword, pronunciation, text and credit; beyond limit cut at a word's border."""
    text = meaning_text(body)
    if limit is not None:
        shorter = lambda t: F.concat(F.regexp_replace(F.substring(t, 1, limit), f"(?<![{WIDE_SPACE}])[{WIDE_SPACE}]++[^{WIDE_SPACE}]*+\\z", ""), F.lit(" …"))
        text = once(text, lambda t: F.when(F.length(t) > limit, shorter(t)).otherwise(t))
    said = F.when(F.coalesce(_c(pron), F.lit("")) != "", F.concat(F.lit(" ["), _c(pron), F.lit("]"))).otherwise("")
    return F.concat(_c(word), said, F.lit("\n\n"), text, F.lit(f"\n\n{credit}"))


def render_inline(s: Text) -> Column:
    """TXT07: a line's control characters as HTML; a missing closer is forgiven."""
    return once(html_escape(s), lambda x: F.when(x.rlike("[\\x02\\x04\\x05\\x0e]"), _inline(x)).otherwise(x))


def _inline(s: Column) -> Column:
    s = F.regexp_replace(s, "\\x02([^\\x03]*)\\x03?", "<cite>$1</cite>")
    s = F.regexp_replace(s, "\\x05([^\\x06]*)\\x06?", '<b class="hl">$1</b>')
    s = F.regexp_replace(s, "\\x0e([^\\x0f]*)\\x0f?", '<span class="pron">[$1]</span>')
    return F.replace(s, F.lit("\u0004"), F.lit('<span class="sub">♦</span>'))


CITE_LINE = f"^\\x02[^\\x03]*\\x03[{WIDE_SPACE}.]*\\z"
VERSE_LINES, VERSE_CHARS = 8, 140


def body_lines(body: Text) -> Column:
    """The lines of a body; a sense begins a line; blank lines go."""
    return F.filter(F.split(F.replace(_c(body), F.lit("\u0001"), F.lit("\n\u0001")), "\n"), lambda x: trim_wide(x) != "")


def render_meaning(body: Text) -> Column:
    """TXT08: paragraphs, with the lines above a citation grouped as verse.

    A line is verse if, going down from it, a citation line comes within eight lines before any line that can't be
    verse. Groups of verse lines take the citation below them.
    """

    def kind(x: Column, cite: Column) -> Column:
        stop = cite | F.startswith(x, F.lit("\u0001")) | F.contains(x, F.lit("\u0004")) | (F.length(x) > VERSE_CHARS) | x.rlike(f"[:：][{WIDE_SPACE}]*\\z")
        return F.struct(x.alias("x"), cite.alias("cite"), stop.alias("stop"))

    def verse(kinds: Column) -> Column:
        """Whether each line is verse: of the next lines the first that stops is a citation."""
        cited = lambda i: F.coalesce(F.get(F.filter(F.slice(kinds, i + 2, F.lit(VERSE_LINES)), lambda k: k["stop"]), F.lit(0))["cite"], F.lit(False))
        return F.transform(kinds, lambda k, i: ~k["stop"] & cited(i))

    def shown(k: Column, i: Column, verses: Column) -> Column:
        """A line; below verse comes verse or its citation."""
        line = F.concat(F.lit("<p>"), render_inline(k["x"]), F.lit("</p>"))
        opened = (i > 0) & F.get(verses, i - 1)
        return (
            F.when(F.get(verses, i), F.concat(F.when(opened, "").otherwise('<div class="verse">'), line))
            .when(k["cite"] & opened, F.concat(render_inline(k["x"]), F.lit("</div>")))
            .when(F.startswith(k["x"], F.lit("\u0001")), F.concat(F.lit('<p class="sense">'), render_inline(F.substring(k["x"], F.lit(2), F.length(k["x"]))), F.lit("</p>")))
            .otherwise(line)
        )

    kinds = F.transform(body_lines(body), lambda x: once(x.rlike(CITE_LINE), lambda cite: kind(x, cite)))
    html = lambda kinds, verses: F.array_join(F.transform(kinds, lambda k, i: shown(k, i, verses)), "")
    return once(kinds, lambda kinds: once(verse(kinds), lambda verses: html(kinds, verses)))
