"""From rows to entries, phrases and headword lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.markup import convert
from glossa.functions.text import collapse, normalize_compact, word_starts
from glossa.sources.shared import materialised


def dense_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """df with 0, 1, 2, ... in the given order, without one task sorting all rows: ranges count, then offsets are added.

    One row per range comes to the driver.
    """
    low = F.lit((1 << 33) - 1)
    placed = materialised(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(low)}))
    counts = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    at = df.sparkSession.createDataFrame(offsets, "_p int, _o long")
    return placed.join(F.broadcast(at), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def entries_from_rows(rows: DataFrame) -> DataFrame:
    """D3: id, source_id, word, pron, body and phrases (kept spellings) of each row, in source order."""
    made = rows.withColumn("word", collapse("word")).withColumn("c", convert("meaning"))
    order = ["source_id", *(c for c in ("file", "block", "line", "at") if c in rows.columns)]
    kept = made.select(*order, "word", "c.pron", "c.body", kept_phrases(F.col("c.phrases"), F.col("word")).alias("phrases"))
    # ranges are found by a pass of their own: what is costly is computed before
    return dense_ids(materialised(kept), order).select("id", "source_id", "word", "pron", "body", "phrases")


def kept_phrases(phrases, word):  # noqa: ANN001, ANN201
    """CNV10: phrases whose compact form isn't empty, the headword's, or that of an earlier phrase."""
    keyed = F.transform(phrases, lambda p: F.struct(p.alias("p"), normalize_compact(p).alias("k")))
    w = normalize_compact(word)
    ok = lambda xs: F.transform(F.filter(F.transform(xs, lambda x, i: F.struct(x["p"].alias("p"), ((x["k"] != "") & (x["k"] != w) & (F.array_position(F.transform(xs, lambda y: y["k"]), x["k"]) == i + 1)).alias("ok"))), lambda x: x["ok"]), lambda x: x["p"])
    return F.element_at(F.transform(F.array(keyed), ok), 1)


def phrases_of(entries: DataFrame) -> DataFrame:
    """D6: phrase_id, phrase, parent_id; numbered by entry and place."""
    each = entries.select(F.col("id").alias("parent_id"), F.posexplode("phrases").alias("ord", "phrase"))
    return dense_ids(materialised(each), ["parent_id", "ord"], "phrase_id").select("phrase_id", "phrase", "parent_id")


def headword_list(df: DataFrame, line: str, display: str, kind: str) -> DataFrame:
    """SRC05, D7: kind, line, display, compact form and the offsets where words start in it."""
    return df.select(F.lit(kind).alias("kind"), F.col(line).cast("long").alias("line"), F.col(display).alias("display"), normalize_compact(display).alias("compact"), word_starts(display).alias("starts"))

