"""URL filters: rules first, then gradient-boosted trees on lexical features.

Every url gets its host, path and the longest fitting rule.  Urls that a rule
decides (or any other labelled urls) train the trees; the trees judge the urls
that no rule fits.  Features are built-in expressions over the url text plus
statistics of the host's suffixes, counted over all rows.

The fit reads at most ``TRAIN_ROWS`` labelled urls (chosen by hash); all urls are
counted, matched and scored.  Block rates are cross-fitted: a labelled url is trained on
the rate that the labels of the other ``FOLDS`` - 1 folds of urls give its suffixes, so
no url sees its own label; urls to be judged get the rate of all labels.  The
statistics hold every suffix and are joined by suffix without a hint: small tables are broadcast, large ones shuffled, where
adaptive execution splits the partitions of hot suffixes.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import stage

RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
TRAIN_ROWS = 20_000
TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 7
SMOOTHING = 20.0  # pseudo-count of a suffix's block rate
FOLDS = 5  # of the urls, for the rates that the trees are fitted on


def lower_ascii(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for NULL urls and urls without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host is the url's or a parent of it and whose path starts the url's."""
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        name, slash, rest = text.partition("/")
        same = (host == name) | host.endswith("." + name)
        fits = same & path.startswith(slash + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits (empty: 0)."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("double")


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "host_depth": count_of(host, "."),
        "path_depth": count_of(path, "/"),
        "digit_ratio": count_of(url, string.digits) / n,
        "host_digits": count_of(host, string.digits),
        "host_hyphens": count_of(host, "-"),
        "entropy": entropy(url),
        "host_entropy": entropy(host),
        "parameters": F.when(query == "", 0.0).otherwise(count_of(query, "&") + 1),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https:")).cast("double"),
    }


def suffix_column(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS)).cast("int")


def _rate(blocked: Column, known: Column) -> Column:
    return (blocked + SMOOTHING / 2) / (known + SMOOTHING)


def suffix_statistics(rows: DataFrame, labels: int) -> DataFrame:
    """Frequency and smoothed block rate of all host suffixes of ``labels`` labels.

    ``rows``: the suffix, ``label`` and ``fold``.  ``_rates`` holds the rate
    without the labels of each fold.
    """
    name = f"suffix{labels}"
    label = F.col("label")
    of = lambda k: F.when(F.col("fold") == k, label)
    counted = rows.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(label).alias("known"),
        F.coalesce(F.sum(label), F.lit(0)).alias("blocked"),
        F.array(*(F.count(of(k)) for k in range(FOLDS))).alias("known_in"),
        F.array(*(F.coalesce(F.sum(of(k)), F.lit(0)) for k in range(FOLDS))).alias("blocked_in"),
    )
    known, blocked = F.col("known"), F.col("blocked")
    without = [_rate(blocked - F.get("blocked_in", k), known - F.get("known_in", k)) for k in range(FOLDS)]
    return counted.select(
        name,
        F.log1p(F.col("n")).alias(f"{name}_frequency"),
        _rate(blocked, known).alias(f"{name}_rate"),
        F.array(*without).alias(f"{name}_rates"),
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    ``labelled``: (url, label) with 1 for block and 0 for allow; without it the
    urls that a rule decides are the labelled ones.  ``score`` is the trees'
    probability of block.  NULL and malformed urls have empty host and path
    and are judged by the trees on what text they have.  With one class or no
    labelled url the score is that class (allow if none).  A url labelled several
    times counts each time.  Urls are read whole, however long.  Ids may be NULL
    or repeated; an empty table gives no rows; other columns are ignored.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), url.alias("u"))
    rows = _with_parts(base, rules)
    rows = rows.withColumn("label", F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0))
    if labelled is not None:
        given = labelled.select(
            F.lit(None).cast(base.schema["id"].dataType).alias("id"),
            F.coalesce(F.col("url").cast("string"), F.lit("")).alias("u"),
            F.col("label").cast("int").alias("label"),
        )
        known = _with_parts(given, rules).select("u", "host", "path", "suffix1", "suffix2", "label")
        unknown = rows.withColumn("label", F.lit(None).cast("int"))
        rows_for_stats = unknown.select(*known.columns).unionByName(known)
    else:
        known = rows.where("label is not null").select("u", "host", "path", "suffix1", "suffix2", "label")
        rows_for_stats = rows
    rows_for_stats = rows_for_stats.select("suffix1", "suffix2", "label", fold_of(F.col("u")).alias("fold"))
    tables = [stage(suffix_statistics(rows_for_stats, k), f"url-suffix{k}") for k in (1, 2)]

    sample = known.where(F.col("label").isin(0, 1)).orderBy(F.xxhash64("u"), "u").limit(TRAIN_ROWS)
    train = stage(_with_features(sample, tables, cross_fitted=True), "url-train")
    classes = [r["label"] for r in train.select("label").distinct().collect()]
    if len(classes) == 2:
        assembler = VectorAssembler(inputCols=_feature_names(), outputCol="features")
        trees = GBTClassifier(
            labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED
        )
        fitted = trees.fit(assembler.transform(train).select("features", F.col("label").cast("double").alias("label")))
        scored = fitted.transform(assembler.transform(_with_features(rows, tables)))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    else:
        scored = rows.withColumn("score", F.lit(float(classes[0]) if classes else 0.0))
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", judged).alias("verdict"), "score"
    )


def _with_parts(base: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    host, path = host_and_path(F.col("u"))
    parts = base.withColumns({"host": host, "path": path})
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    suffixes = {f"suffix{k}": suffix_column(F.col("host"), k) for k in (1, 2)}
    return parts.withColumns({"rule": rule, "action": action, **suffixes})


def _feature_names() -> list[str]:
    names = list(lexical_features(F.lit(""), F.lit(""), F.lit("")))
    return names + [f"suffix{k}_{what}" for k in (1, 2) for what in ("frequency", "rate")]


def _with_features(rows: DataFrame, tables: Sequence[DataFrame], cross_fitted: bool = False) -> DataFrame:
    """All features; ``cross_fitted``: rates without the labels of the row's own fold."""
    out = rows
    for k, table in zip((1, 2), tables, strict=True):
        out = out.join(table, f"suffix{k}", "left")  # every suffix is in it
        if cross_fitted:
            out = out.withColumn(f"suffix{k}_rate", F.get(f"suffix{k}_rates", fold_of(F.col("u"))))
        out = out.drop(f"suffix{k}_rates")
    return out.withColumns(lexical_features(F.col("u"), F.col("host"), F.col("path")))
