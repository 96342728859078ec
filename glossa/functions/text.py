"""Text functions: the normalisation table, tokens, word starts, term tests, entities, plain views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The normalisation table.
YEH = "\u064a\u0649\u0626\u06cd\u06d0\u06d2\u06d3"
KAF = "\u0643\u06aa"
HEH = "\u0629\u06c0\u06d5\u06c1\u06be"
ALEF = "\u0623\u0625\u0622\u0671\u0672\u0673"
WAW = "\u0624"
ARABIC_DIGITS = "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669"
PERSIAN_DIGITS = "\u06f0\u06f1\u06f2\u06f3\u06f4\u06f5\u06f6\u06f7\u06f8\u06f9"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DELETED = "".join(map(chr, range(0x064B, 0x0660))) + "\u0670\u0640\u0621\u200d\u200e\u200f\ufeff\u00ad\u0000"
SEPARATORS = "\t\n\r \u00a0\u200c\u200b" + ".,;:!?()[]{}<>\"'`/\\|-_=+*&^%$#@~" + "\u00ab\u00bb\u060c\u061b\u061f\u066a\u066b\u066c\u2026\u2013\u2014\u2010\u2022\u2666\u25c4"
#: White space as the web's scripting language has it, for use in a character class.
WIDE_SPACE = "\\t\\n\\x0B\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Runs of white space other than one plain space, which is what they become: most of a text's white space is left alone.
#: Most letters fail the first class, which is as short as can be.
BLANKS = f"[\\t\\n\\x0B\\f\\r \u00a0\u1680-\u3000\ufeff](?:(?<=[{WIDE_SPACE.replace(' ', '')}])[{WIDE_SPACE}]*+|(?<= )[{WIDE_SPACE}]++)"
#: What ends a word in running text.
WORD_ENDS = WIDE_SPACE + ".,;:!?()\\[\\]\u00ab\u00bb\"'\u060c\u061b\u061f"
ZWNJ = "\u200c"
MIN_PREFIX = 3

MAP_FROM = YEH + KAF + HEH + ALEF + WAW + ARABIC_DIGITS + PERSIAN_DIGITS + CAPITALS + SEPARATORS + DELETED
MAP_TO = "\u06cc" * len(YEH) + "\u06a9" * len(KAF) + "\u0647" * len(HEH) + "\u0627" * len(ALEF) + "\u0648" + "0123456789" * 2 + CAPITALS.lower() + " " * len(SEPARATORS)

_IN = lambda letters: [c for c in map(chr, range(1 << 16)) if re.match(f"[{letters}]", c)]
BLANK_LETTERS = "".join(_IN(WIDE_SPACE))
#: Letter by letter, so that places stay: what ends a word is a space, what the compact form leaves out a soft hyphen.
GONE = "\u00ad"
_PLACED = {c: GONE if m in ("", " ") else m for c, m in reversed(list(zip(MAP_FROM, list(MAP_TO) + [""] * len(MAP_FROM), strict=False)))} | dict.fromkeys([*_IN(WORD_ENDS), "\u001f"], " ")

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def char_map(s: Text) -> Column:
    """NRM01: the table, letter by letter; letters without a counterpart go."""
    return F.translate(_c(s), MAP_FROM, MAP_TO)


def normalize_spaced(s: Text, keep_newlines: bool = False) -> Column:
    """NRM02: mapped, separators to one space, trimmed. With keep_newlines each line on its own."""
    if keep_newlines:
        return F.array_join(F.transform(F.split(_c(s), "\n"), lambda x: normalize_spaced(x)), "\n")
    return F.trim(F.regexp_replace(char_map(s), " {2,}+", " "))


def normalize_compact(s: Text) -> Column:
    """NRM03: the spaced form without spaces."""
    return F.replace(char_map(s), F.lit(" "), F.lit(""))


def tokenize(s: Text) -> Column:
    """NRM04: words of more than one letter; a zero-width non-joiner joins its parts."""
    return F.filter(F.split(char_map(F.replace(_c(s), F.lit(ZWNJ), F.lit(""))), " +"), lambda t: F.length(t) > 1)


def word_starts(s: Text) -> Column:
    """NRM05: offsets in the compact form where a word starts."""
    words = F.filter(F.split(char_map(s), " "), lambda t: t != "")
    sizes = F.transform(words, lambda t: F.length(t))
    return F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))


def term_test(word: Text, terms: Column) -> Column:
    """NRM06: 2 where the word is a term, 1 where it starts with one of three letters or more, else 0."""
    return F.element_at(F.transform(F.array(normalize_compact(F.replace(_c(word), F.lit(ZWNJ), F.lit("")))), lambda t: F.when(t == "", 0).when(F.array_contains(terms, t), 2).when(F.exists(terms, lambda x: (F.length(x) >= MIN_PREFIX) & F.startswith(t, x)), 1).otherwise(0)), 1)


def persian_digits(s: Text) -> Column:
    """NRM07. Texts without such digits are only looked at."""
    return once(_c(s), lambda x: F.when(x.rlike("[\u0660-\u0669]"), F.translate(x, ARABIC_DIGITS, PERSIAN_DIGITS)).otherwise(x))


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def replace_each(s: Text, pattern: str, fn: Callable[[Column], Column], mark: str, group: int = 1) -> Column:
    """Each match of pattern becomes fn of its group. Only texts that hold mark, which is in every match, are searched."""

    def replaced(x: Column) -> Column:
        between, found = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(group))
        joined = F.array_join(F.zip_with(between, F.transform(found, fn), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(F.contains(x, F.lit(mark)), joined).otherwise(x)

    return once(_c(s), replaced)


_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "nbsp": " ", "zwnj": ZWNJ}


def _entity(e: Column) -> Column:
    low = F.lower(e)
    out = F.when(F.lit(False), e)
    for name, c in _NAMED.items():
        out = out.when(low == f"&{name};", F.lit(c))
    digits = F.regexp_extract(low, "^&#x?([0-9a-f]+);$", 1)
    cp = F.when(low.rlike("^&#x0*[0-9a-f]{1,6};$"), F.conv(digits, 16, 10)).when(low.rlike("^&#0*[0-9]{1,7};$"), F.conv(digits, 10, 10)).cast("int")
    real = (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return out.when(real, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")).otherwise(e)


def decode_entities(s: Text) -> Column:
    """NRM08: one pass; unknown names and impossible numbers stay as they are."""
    return replace_each(s, "(?i)(&(?:#x?[0-9a-f]+|[a-z]+);)", _entity, mark="&")


def collapse(s: Text) -> Column:
    """NRM10: white space to one space, trimmed."""
    return F.trim(F.regexp_replace(_c(s), BLANKS, " "))


TAG = "</?[a-zA-Z][^>]*>"


def clean(s: Text) -> Column:
    """NRM09: without tags, entities decoded, Persian digits, white space collapsed."""
    return collapse(persian_digits(decode_entities(F.regexp_replace(_c(s), TAG, ""))))


def html_escape(s: Text) -> Column:
    """TXT06."""
    s = _c(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def persian_number(n: Text) -> Column:
    """TXT11: digits and grouping of the Persian locale."""
    return F.translate(F.format_number(_c(n), 0), "0123456789,", PERSIAN_DIGITS + "\u066c")


def capped_count(n: Text, limit: int) -> Column:
    """TXT11: a count as it is shown, with a plus sign where it has reached the limit."""
    n = _c(n)
    return F.when(n >= limit, F.concat(F.lit("+"), persian_number(F.lit(limit)))).otherwise(persian_number(n))


def find_term(s: Text, terms: Column) -> Column:
    """TXT02: the offset of the first word that is a term, else of the first that starts with one, else -1.

    The text is mapped letter by letter, so that a term is a pattern in it and its place that of the word (a unit
    separator parts words too). A term that isn't in its compact form is no word's.
    """
    placed = lambda x: F.translate(x, "".join(_PLACED), "".join(_PLACED.values()))
    escaped = lambda c: F.when(c.rlike("[\\p{L}\\p{N}]"), c).otherwise(F.concat(F.lit("\\"), c))
    letters = lambda t: F.when(t == "", f"(?<={GONE})").otherwise(F.array_join(F.transform(F.split(t, ""), lambda c: F.concat(escaped(c), F.lit(GONE + "*+"))), ""))
    known = F.filter(terms, lambda t: (placed(t) == t) & ~t.rlike(f"[ {GONE}]"))

    def before(x: Column, terms: Column, end: str) -> Column:
        """The letters before the first word that begins with a term and then has end."""
        words = F.concat(F.lit(f"(?<![^ ]){GONE}*+(?:"), F.array_join(F.transform(terms, letters), "|"), F.lit(f"){end}"))
        return F.when(F.size(terms) > 0, once(F.split(x, words, 2), lambda parts: F.when(F.size(parts) > 1, F.length(parts[0]))))

    def place(x: Column) -> Column:
        return F.coalesce(before(x, known, "(?![^ ])"), before(x, F.filter(known, lambda t: F.length(t) >= MIN_PREFIX), ""), F.lit(-1))

    return once(placed(_c(s)), place)


def snippet(text: Text, terms: Column) -> Column:
    """TXT03: 160 letters from shortly before the first term, from the start where that is near."""

    def cut(t: Column, at: Column) -> Column:
        begin = once(F.substring(t, F.lit(1), at - 40 + 1), lambda head: once(F.locate(" ", F.reverse(head)), lambda k: F.when(k > 0, F.length(head) - k + 1).otherwise(0)))
        s = F.when(at <= 40, F.substring(t, 1, 160)).otherwise(F.concat(F.lit("\u2026 "), F.substring(t, begin + 1, F.lit(160))))
        shorter = lambda s: F.concat(F.regexp_replace(s, f"[{WIDE_SPACE}]+[^{WIDE_SPACE}]*\\z", ""), F.lit(" \u2026"))
        return once(s, lambda s: F.when(F.length(s) < F.length(t), shorter(s)).otherwise(s))

    return once(_c(text), lambda t: once(find_term(t, terms), lambda at: cut(t, at)))


def highlight_query(word: Text, query: Column) -> Column:
    """HWS10: the word, escaped, with the letters of the first match of the query in bold."""
    word = _c(word)
    letters = F.filter(F.split(word, ""), lambda x: x != "")
    each = F.transform(letters, lambda x: normalize_compact(x))
    q = normalize_compact(query)

    def marked(letters: Column, each: Column, q: Column) -> Column:
        # place of the match in the compact form, then of its letters among those that stay
        at = F.position(q, F.array_join(each, ""))
        stays = F.filter(F.transform(each, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["x"] != "")
        s = F.get(stays, at - 1)["i"]
        e = F.get(stays, at + F.length(q) - 2)["i"] + 1
        # marks behind the last letter belong to it, a plain space doesn't
        behind = F.transform(F.slice(letters, e + 1, F.size(letters)), lambda x, i: F.when((normalize_compact(x) != "") | (x == " "), i))
        e = e + F.coalesce(F.array_min(behind), F.size(letters) - e)
        part = lambda a, b: html_escape(F.array_join(F.slice(letters, a + 1, b - a), ""))
        bold = F.concat(part(F.lit(0), s), F.lit("<b>"), part(s, e), F.lit("</b>"), part(e, F.size(letters)))
        return F.when((q == "") | (at == 0), html_escape(F.array_join(letters, ""))).otherwise(bold)

    once = F.transform(F.array(F.struct(letters.alias("l"), each.alias("e"), q.alias("q"))), lambda x: marked(x["l"], x["e"], x["q"]))
    return F.element_at(once, 1)


def mark_terms(text: Text, terms: Column) -> Column:
    """TXT09: text, escaped, with the words that pass the term test marked."""
    text = _c(text)
    between = F.split(text, f"[^{WORD_ENDS}]+", -1)
    words = F.regexp_extract_all(text, F.lit(f"([^{WORD_ENDS}]+)"), F.lit(1))
    shown = F.transform(words, lambda w: F.when(term_test(w, terms) > 0, F.concat(F.lit("<mark>"), html_escape(w), F.lit("</mark>"))).otherwise(html_escape(w)))
    return F.array_join(F.zip_with(F.transform(between, lambda x: html_escape(x)), shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
