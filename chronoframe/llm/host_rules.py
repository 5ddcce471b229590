"""Quality rules with host verdicts.

Every document is measured by rules on its own text.  Rule failures are counted by
host; a host's failure rate is shrunk towards the corpus by a beta prior that is
itself estimated from the spread of the host rates, so a host of two documents
is not condemned by one of them while a host of a million is judged by its own
rate.  Verdicts are joined back: a document goes if it fails a base rule, or if it
stands on a host whose shrunk rate reaches ``MAX_RATE``.

All built-in expressions.  The measures are written once, as narrow rows; a host's
counts are partial aggregates, so a host with a third of all rows costs one row a
task, and the join back moves no text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import free_name, stage, whole_text
from chronoframe.llm.line_dedup import words_of

WINDOW = 5  # words of a repeated window
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20  # of the words, inside repeated windows
MAX_SYMBOL_PERCENT = 10  # symbols per 100 words
MAX_DUP_LINE_PERCENT = 30  # of the lines with a word
MEAN_WORD = (2, 25)  # characters
SYMBOLS = "#*$%&|<>"
MAX_RATE = 0.5  # shrunk failure rate at which a host goes
DEFAULT_STRENGTH = 20.0  # pseudo-documents of the prior where the hosts cannot tell
STRENGTH = (1.0, 10_000.0)


# ---- measures of one text ----------------------------------------------------


def _neighbours_equal(rows: Column, key: str) -> Column:
    """The entries of a sorted array of structs whose ``key`` stands next to an equal one."""

    def twin(x: Column, i: Column) -> Column:
        same = lambda j: F.coalesce(F.get(rows, j)[key] == x[key], F.lit(False))
        return same(i - 1) | same(i + 1)

    return F.filter(rows, twin)


def with_repeat_words(df: DataFrame, words: str, out: str, window: int = WINDOW) -> DataFrame:
    """``df`` with ``out``: the words inside windows that occur twice or more in the array ``words``.

    Hashes single out the windows that may repeat (equal windows have equal
    hashes); only those are compared as text, so the count is exact.
    """
    n = F.size(words)
    h, hs, ks, at = (free_name(df, f"_{name}") for name in ("hash", "hashes", "texts", "starts"))
    word = lambda i, k: F.get(F.col(words), i + k)
    places = F.sequence(F.lit(0), n - window)
    step = df.withColumn(
        h, F.when(n >= window, F.transform(places, lambda i: F.xxhash64(*(word(i, k) for k in range(window)))))
    )
    some = F.size(F.array_distinct(h)) < F.size(h)
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    step = step.withColumn(hs, F.when(some, F.sort_array(pairs)))
    text = lambda i: F.concat_ws(" ", F.slice(F.col(words), i + 1, window))
    named = F.transform(_neighbours_equal(F.col(hs), "h"), lambda x: F.struct(text(x["i"]).alias("k"), x["i"].alias("i")))
    step = step.withColumn(ks, F.sort_array(named))
    step = step.withColumn(at, F.sort_array(F.transform(_neighbours_equal(F.col(ks), "k"), lambda x: x["i"])))
    reach = F.transform(at, lambda x, j: F.coalesce(F.least(F.lit(window), F.get(at, j + 1) - x), F.lit(window)))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return step.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop(h, hs, ks, at)


def rule_measures(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    """One row per input row: id, ``host``, the counts of its text, ``base_failed`` and ``failed``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), whole_text().alias("text"))
    rows = with_repeat_words(rows.withColumn("w", words_of(F.col("text"))), "w", "n_repeat_words")
    lines = F.filter(F.split("text", "\n"), lambda line: F.size(words_of(line)) > 0)
    rows = rows.withColumn("lines", lines)
    without = lambda chars: F.length(F.translate("text", chars, ""))
    measured = rows.select(
        "id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        without(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length("text") - without(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    own = [
        F.col("n_symbols") * 100 > n * MAX_SYMBOL_PERCENT,
        F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINE_PERCENT,
        F.col("word_chars") < n * MEAN_WORD[0],
        F.col("word_chars") > n * MEAN_WORD[1],
    ]
    return measured.withColumn("base_failed", base).withColumn(
        "failed", reduce(lambda x, y: x | y, own, F.col("base_failed"))
    )


# ---- hosts -------------------------------------------------------------------


def beta_prior(hosts: DataFrame) -> DataFrame:
    """One row (``mean``, ``strength``): beta prior of the failure rates of (n, failed) rows.

    The strength comes from the spread of the host rates beyond what chance
    gives (method of moments of the beta-binomial): no spread beyond chance is
    the strongest prior, hosts that are all or nothing the weakest.
    """
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.sum(n * n).alias("nn")
    )
    mean = F.col("f") / F.col("n")
    noise = F.col("mean") * (1 - F.col("mean"))
    room = F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)
    spread = (F.col("ff") - F.col("n") * F.col("mean") * F.col("mean")) / noise - (F.col("k") - 1)
    known = (F.col("k") > 1) & (noise > 0) & (room > 0)
    strength = F.when(spread <= 0, STRENGTH[1]).otherwise(room / spread - 1)
    bounded = F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), strength))
    return sums.withColumn("mean", mean).select("mean", F.when(known, bounded).otherwise(DEFAULT_STRENGTH).alias("strength"))


def host_verdicts(measures: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n, failed, rate, rejected) for every host that is not NULL; ``rate`` is the shrunk one."""
    hosts = measures.where("host is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failed")
    )
    hosts = stage(hosts, "host-counts")
    prior = beta_prior(hosts)
    mean, strength = prior.select("mean").scalar(), prior.select("strength").scalar()
    judged = hosts.withColumns({"mean": mean, "strength": strength})
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return judged.select("host", "n", "failed", shrunk.alias("rate")).withColumn("rejected", F.col("rate") >= max_rate)


def apply_host_rules(
    docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", max_rate: float = MAX_RATE
) -> DataFrame:
    """One row per input row: id, ``host``, its measures, ``base_failed``, ``failed``, ``host_rate``, ``kept``.

    ``failed`` says that the text fails any rule; ``host_rate`` is the shrunk rate of
    its host.  NULL and empty texts have no words and fail the base rule.
    Documents without a host (NULL) count for no host and are judged by the base
    rules alone.  Ids may be NULL or repeated: every row is measured and counted.
    Texts are measured whole, whatever their length.  An empty table gives no
    rows; other columns are ignored.
    """
    measures = stage(rule_measures(docs, id_col, host_col), "host-measures")
    hosts = host_verdicts(measures, max_rate).select("host", F.col("rate").alias("host_rate"), "rejected")
    joined = measures.join(hosts, "host", "left")
    kept = ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))
    return joined.withColumn("kept", kept).drop("rejected").withColumnRenamed("id", id_col)
