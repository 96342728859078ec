"""Quality rules: base rules of each document, failure rates of hosts shrunk by an empirical beta prior, verdicts joined back.

DataFrame and SQL functions only. Base features are computed in one pass without a shuffle and written to the
shared folder; hosts come from a partial aggregation, so a host with a third of all rows is a sum like any other.

Defined results: a null text has no words and fails; a null host gets no verdict of its own (its documents keep
what the base rules say); a text of any length is ruled whole, within its row; a host whose shrunk rate is exactly the
limit stays; repeated rows each count; an empty table gives an empty result; other columns don't matter.
8-word windows of a document are compared by their 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import SPACE, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6
#: A prior as strong as this many documents at least and at most.
PRIOR_DOCS = (2.0, 1000.0)


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed in place of the text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_text", raw).withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long"),
            "_lines": lines,
            "_windows": F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))),
        }
    )
    out = out.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_sorted": F.when(F.size("_windows") > F.size(F.array_distinct("_windows")), F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
        }
    )
    out = out.withColumn("_starts", F.array_sort(F.transform(F.filter("_sorted", _has_twin), lambda x: x["i"])))
    out = out.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_starts")), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_text", "_words", "_lines", "_windows", "_sorted", "_starts")


def _has_twin(x: Column, i: Column) -> Column:
    """x stands next to an equal hash in the sorted windows."""
    around = lambda k: F.get(F.col("_sorted"), k)["h"]
    return F.coalesce(around(i - 1) == x["h"], F.lit(False)) | F.coalesce(around(i + 1) == x["h"], F.lit(False))


def _covered(starts: Column) -> Column:
    """Words under windows that begin at the sorted starts."""
    steps = F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def host_verdicts(features: DataFrame, host: str) -> DataFrame:
    """One row per host: host, host_docs, host_failures, host_rate (shrunk), host_kept.

    The beta prior comes from the hosts themselves by the method of moments, each host weighing as its documents.
    """
    hosts = features.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    hosts = written(hosts)
    rate = F.col("host_failures") / F.col("host_docs")
    docs, failures, squares, hosts_n = hosts.agg(F.sum("host_docs"), F.sum("host_failures"), F.sum(F.col("host_docs") * rate * rate), F.count("*")).head()
    mean = failures / docs if docs else 0.0
    between = max(squares / docs - mean * mean, 0.0) if docs else 0.0
    noise = mean * (1 - mean) * hosts_n / docs if docs else 0.0
    true = max(between - noise, 1e-9)
    strength = min(max(mean * (1 - mean) / true - 1, PRIOR_DOCS[0]), PRIOR_DOCS[1])
    shrunk = (F.col("host_failures") + F.lit(strength * mean)) / (F.col("host_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= MAX_HOST_RATE)


def apply_rules(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (all but the text where None), the base features, host_rate and kept."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    features = written(base_features(docs.select(*[F.col(c).alias(f"in_{c}") for c in keep], F.col(host).alias("_host"), F.col(text).alias("_in")), "_in").drop("_in"))
    verdicts = host_verdicts(features, "_host").select("host", "host_rate", "host_kept")
    joined = features.join(verdicts, F.col("_host") == F.col("host"), "left").drop("_host", "host")
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    return joined.withColumn("kept", kept).drop("host_kept").withColumnsRenamed({f"in_{c}": c for c in keep})
