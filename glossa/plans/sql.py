"""DuckDB forms of the text functions, for the SQL beside the registered queries."""

from __future__ import annotations


def _chars(*points: str) -> str:
    """The letters of code points and of ranges of them."""
    ends = [[int(x, 16) for x in p.split("-")] for p in points]
    return "".join(chr(c) for x in ends for c in range(x[0], x[-1] + 1))


# Fixed values, written here once more so that the SQL doesn't depend on the engine's own tables.
FOLDED = (
    (_chars("064A", "0649", "0626", "06CD", "06D0", "06D2", "06D3"), "\u06cc"),
    (_chars("0643", "06AA"), "\u06a9"),
    (_chars("0629", "06C0", "06D5", "06C1", "06BE"), "\u0647"),
    (_chars("0623", "0625", "0622", "0671", "0672", "0673"), "\u0627"),
    (_chars("0624"), "\u0648"),
)
BLANK_LIKE = _chars("09", "0A", "0D", "20", "A0", "200C", "200B") + r""".,;:!?()[]{}<>"'`/\|-_=+*&^%$#@~""" + _chars("00AB", "00BB", "060C", "061B", "061F", "066A", "066B", "066C", "2026", "2013", "2014", "2010", "2022", "2666", "25C4")
GONE = _chars("064B-065F", "0670", "0640", "0621", "200D", "200E", "200F", "FEFF", "00AD")
ARABIC_DIGITS, PERSIAN_DIGITS = _chars("0660-0669"), _chars("06F0-06F9")
ZWNJ = "\u200c"
#: White space for a character class.
WS = "\\t\\n\\x0B\\f\\r " + _chars("00A0", "1680") + "\u2000-\u200a" + _chars("2028", "2029", "202F", "205F", "3000", "FEFF")
#: What ends a word in running text.
WORD_ENDS = WS + ".,;:!?()\\[\\]" + _chars("00AB", "00BB") + "\"'" + _chars("060C", "061B", "061F")
TAG = "</?[a-zA-Z][^>]*>"


def quoted(s: str) -> str:
    return "'" + s.replace("\u0000", "").replace("'", "''") + "'"


def mapped(x: str) -> str:
    """Letter by letter; what has no counterpart at the end of the list goes."""
    pairs = [(c, to) for letters, to in FOLDED for c in letters] + [(c, str(i)) for digits in (ARABIC_DIGITS, PERSIAN_DIGITS) for i, c in enumerate(digits)]
    pairs += [(chr(c), chr(c + 32)) for c in range(65, 91)] + [(c, " ") for c in BLANK_LIKE]
    return f"translate({x}, {quoted(''.join(a for a, _ in pairs) + GONE)}, {quoted(''.join(b for _, b in pairs))})"


def spaced(x: str) -> str:
    return f"trim(regexp_replace({mapped(x)}, ' +', ' ', 'g'))"


def compact(x: str) -> str:
    return f"replace({mapped(x)}, ' ', '')"


def tokens(x: str) -> str:
    joined = f"replace({x}, {quoted(ZWNJ)}, '')"
    return f"list_filter(string_split({mapped(joined)}, ' '), lambda t: length(t) > 1)"


def starts(x: str) -> str:
    """Offsets in the compact form where a word starts."""
    return f"""(SELECT coalesce(list(CAST(o AS INTEGER) ORDER BY i), []) FROM (
      SELECT i, coalesce(sum(length(w)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
      FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT list_filter(string_split({mapped(x)}, ' '), lambda t: t <> '') AS ws))))"""


def starts_of(column: str) -> str:
    """The same from the list of a text's word lengths, as a chain of list functions."""
    words = f"list_filter(string_split({mapped(column)}, ' '), lambda t: t <> '')"
    sizes = f"list_transform({words}, lambda t: length(t))"
    return f"list_transform(range(1, len({words}) + 1), lambda i: CAST(coalesce(list_sum(({sizes})[1:i - 1]), 0) AS INTEGER))"


def plain_for_index(x: str) -> str:
    s = f"regexp_replace({x}, '\\x02[^\\x03]*\\x03', ' ', 'g')"
    s = f"regexp_replace({s}, '\\([^()\\n]{{0,40}}\\)', ' ', 'g')"
    return f"regexp_replace({s}, '[\\x00-\\x1f]', ' ', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def trim_wide(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decode_entities(x: str) -> str:
    """Named entities; the ampersand last, so that nothing is decoded twice."""
    for name, c in NAMED:
        x = f"regexp_replace({x}, '(?i){name}', {quoted(c)}, 'g')"
    return x


def persian_digits(x: str) -> str:
    return f"translate({x}, {quoted(ARABIC_DIGITS)}, {quoted(PERSIAN_DIGITS)})"


def tidy(x: str) -> str:
    s = f"regexp_replace({x}, '[ \\t\\r\\x{{00a0}}]+', ' ', 'g')"
    s = f"regexp_replace({s}, ' ?([\\n\\x01-\\x06]) ?', '\\1', 'g')"
    s = f"regexp_replace({s}, '\\n*\\x01\\n*', chr(1), 'g')"
    s = f"regexp_replace({s}, '\\n{{2,}}', chr(10), 'g')"
    return trim_wide(s)


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '{TAG}', '', 'g')"


def strip_markup(x: str) -> str:
    br = f"regexp_replace({x}, '(?i)<br[{WS}]*/?>', chr(10), 'g')"
    return tidy(persian_digits(decode_entities(strip_tags(br))))
