r"""Reading table dumps: INSERT statements of a three-column table.

A statement is `INSERT INTO` (in any case), anything up to `VALUES`, tuples in parentheses with commas between them, and a semicolon.
Quoted values may hold backslash escapes and doubled quotes; other values run to white space, a comma or a closing
parenthesis. Tuples are found only behind a statement's `VALUES`, each right behind the one before; whatever breaks a
statement off is an error that names the file, and what lies between statements is skipped. The patterns are
possessive, so long values don't nest calls.

Whole files allow any layout and are one task each. By line, files are split between tasks: a tuple (or several) to a
line, a statement's head on a line of its own or before its tuples; a line that begins a tuple or a statement and
doesn't fit is an error, and values with raw line breaks need whole files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.text import replace_each

_QUOTED = r"'[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+'"
_FIELD = rf"(?:{_QUOTED}|(?!')[^\s,)]*+)"
_TUPLE = rf"\(\s*+{_FIELD}\s*+(?:,\s*+{_FIELD}\s*+)*+\)"
_INTO = r"(?i:\bINSERT\s++INTO\b)"
_HEAD = rf"{_INTO}[\s\S]*?(?i:\bVALUES)"
#: A statement's head with its first tuple, or a further tuple right behind the last match, with what follows it in sight.
_STEP = rf"(?:{_HEAD}|\G(?!\A),)\s*+({_TUPLE})\s*+(?=[,;])"
#: Stands for a tuple that was read, when a text is looked at for what wasn't.
_READ = "\ue000"
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\u0000", "Z": "\u001a", "b": "\b"}


def unquote(value: Column) -> Column:
    """A field's value: escapes undone where it is quoted, as it stands otherwise."""
    inner = F.substring(value, F.lit(2), F.length(value) - 2)

    def undone(x: Column) -> Column:
        out = F.when(x == "''", F.lit("'"))
        for c, to in _ESCAPES.items():
            out = out.when(x == f"\\{c}", F.lit(to))
        return out.otherwise(F.substring(x, 2, 1))

    return F.when(F.startswith(value, F.lit("'")), replace_each(inner, r"(\\[\s\S]|'')", undone, mark="")).otherwise(value)


def _rows(texts: DataFrame, tuples: Column, order: list[str]) -> DataFrame:
    """file, the columns of order, at, source_id, word and meaning of the tuples of each text."""
    rows = texts.select("file", *order, F.posexplode(tuples).alias("at", "row"))
    inner = F.regexp_replace("row", r"^\(\s*+|\s*+\)\z", "")
    # an empty field at the end has no text of its own to match
    fields = F.regexp_extract_all(inner, F.lit(rf"(?:^|\G,)\s*+({_FIELD})\s*+(?=,|\z)"), F.lit(1))
    rows = rows.withColumn("f", F.transform(fields, unquote))
    short = F.raise_error(F.concat(F.lit("a row of fewer than three values in "), F.col("file"), F.lit(": "), F.col("row")))
    third = F.when(F.size("f") < 3, short).otherwise(F.get("f", F.lit(2)))
    return rows.select("file", *order, F.col("at").cast("long"), F.expr("try_cast(f[0] AS int)").alias("source_id"), F.get("f", F.lit(1)).alias("word"), third.alias("meaning"))


def parse_dump(texts: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """file, at (place of the row in its text), source_id, word, meaning of each tuple of whole texts."""
    found = F.regexp_extract_all("t", F.lit(_STEP), F.lit(1))
    left = F.regexp_replace("t", _STEP, _READ)
    # a head that is left has no sound first tuple; a comma behind a tuple that was read has none after it
    broken = left.rlike(rf"{_INTO}|{_READ}\s*+,")
    sound = F.when(broken, F.raise_error(F.concat(F.lit("a statement breaks off in "), F.col("file")))).otherwise(found)
    return _rows(texts.select(F.col(text).alias("t"), F.col(file).alias("file")), sound, [])


def parse_dump_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """The same of lines with file, block and line (their order in the file)."""
    tuples = F.regexp_extract_all("t", F.lit(rf"(?:^|\G[,;]|{_HEAD})\s*+({_TUPLE})\s*+(?=[,;])"), F.lit(1))
    begins = F.col("t").rlike(r"^\s*+\(")
    head = F.col("t").rlike(_INTO)
    sound = F.col("t").rlike(rf"^\s*+{_TUPLE}\s*+(?:,\s*+{_TUPLE}\s*+)*+[,;]\s*\z") | F.col("t").rlike(rf"{_INTO}(?:(?!(?i:\bVALUES)).)*+(?:(?i:VALUES)\s*+(?:{_TUPLE}\s*+(?:,\s*+{_TUPLE}\s*+)*+[,;]\s*+)?)?\z")
    none = F.array().cast("array<string>")
    checked = F.when((begins | head) & ~sound, F.raise_error(F.concat(F.lit("a statement breaks off in "), F.col("file"), F.lit(": "), F.substring("t", 1, 80)))).when(begins | head, tuples).otherwise(none)
    return _rows(lines.select(F.col(text).alias("t"), "file", "block", "line"), checked, ["block", "line"])


def read_dumps(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Rows of all dump files that path names, tagged with the file's name. By line with block and line, their order in the file."""
    texts = spark.read.text(path, wholetext=whole).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if whole:
        return parse_dump(texts.drop("block"))
    # lines of a block are read in order, by one task
    return parse_dump_lines(texts.withColumn("line", F.monotonically_increasing_id()))
