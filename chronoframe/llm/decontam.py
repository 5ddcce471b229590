"""Benchmark decontamination with spaced seeds.

A document overlaps a benchmark item where ``WINDOW`` consecutive words of both
agree, position by position, but for at most ``MAX_SUBSTITUTIONS`` words.  A
spaced seed hashes the words at the positions of a fixed mask and ignores the
others, so a substitution at an ignored position does not hide the seed.  The
masks below are chosen so that every window with at most two substitutions
holds a complete seed of one of them at some offset (a test enumerates all
patterns); hence the seed join loses no overlap.

An item of ``SHORTEST`` to ``WINDOW - 1`` words is its own window and must agree in
every word; its first words are a complete seed.  Shorter items are common
phrases rather than passages and never match.

Test-side seeds are joined to the seeds of every position of every document by a
broadcast whose size is counted first; a benchmark whose seeds and the words around
them take more than ``BLOCK_BYTES`` is joined in blocks of seeds, each against all rows,
so neither many items nor one very long item make a broadcast larger.
Around each hit the at most ``2 * WINDOW - span`` aligned words are compared, so
a hit costs the same whatever the length of document or item, and only verified
windows leave the scan stage.  Everything is built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import stage, whole_text
from chronoframe.llm.line_dedup import drop_rows

WINDOW = 13
MAX_SUBSTITUTIONS = 2
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SHORTEST = min(m[-1] for m in MASKS) + 1  # words of the shortest item that can match
BLOCK_BYTES = 64 << 20  # seeds broadcast at once
SEED_BYTES = 8 * (2 * WINDOW - 1) + 64  # a seed with the words around it


def words_of(text: Column) -> Column:
    """Lower-cased runs of characters other than space and U+0009 to U+000D."""
    spaced = F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def seed(mask: int, words: Column, at: Column) -> Column:
    """Hash of the words at the mask's positions from ``at`` on (0-based)."""
    return F.xxhash64(F.lit(mask), *(F.get(words, at + p) for p in MASKS[mask]))


def seeds(table: DataFrame, words: str, *keep: str) -> DataFrame:
    """One row per complete or partial seed: ``keep``, ``words``, ``at``, ``mask``, ``seed``."""
    started = table.where(F.size(words) >= SHORTEST).select(
        *keep, words, F.explode(F.sequence(F.lit(0), F.size(words) - SHORTEST)).alias("at")
    )
    both = F.array(*(seed(m, F.col(words), F.col("at")) for m in range(len(MASKS))))
    return started.select(*keep, words, "at", F.posexplode(both).alias("mask", "seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row per overlapping (document, item): ids, ``text_key``, ``first_word``, ``last_word``, ``n_windows``.

    ``first_word`` and ``last_word`` (exclusive) bound the verified windows in the
    document, ``n_windows`` counts where they start.  ``text_key`` is the text's xxhash64, which tells rows of
    equal id apart; rows equal in both, NULL ids included, are reported
    together, and so are items of equal id.  Texts and items of fewer than ``SHORTEST`` words,
    NULL and empty ones never overlap, nor does anything with an empty table; texts and
    items of any length are read whole.  Other columns are ignored.
    """
    text = whole_text()
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), word_hashes(text).alias("words"))
    items = benchmark.select(F.col(item_col).alias("item"), word_hashes(whole_text()).alias("item_words"))
    items = items.where(F.size("item_words") >= SHORTEST).distinct()
    n_seeds = items.agg(F.sum(F.size("item_words"))).first()[0] or 0
    n_blocks = max(1, -(-len(MASKS) * n_seeds * SEED_BYTES // BLOCK_BYTES))
    wanted = seeds(items, "item_words", "item")
    block = F.pmod(F.xxhash64(F.lit("block"), "item", "at", "mask", "seed"), F.lit(n_blocks))
    found = [_block_overlaps(d, wanted.where(block == b)) for b in range(n_blocks)]
    windows = reduce(DataFrame.unionByName, found)
    return (
        windows.groupBy("id", "text_key", "item")
        .agg(
            F.min("start").alias("first_word"),
            F.max("end").alias("last_word"),
            F.count_distinct("start").alias("n_windows"),
        )
        .withColumnsRenamed({"id": id_col, "item": item_col})
    )


def _block_overlaps(d: DataFrame, wanted: DataFrame) -> DataFrame:
    """Verified (id, text_key, item, start, end) windows against one block of the items' seeds."""
    n = F.size("item_words")
    wanted = wanted.select(
        "seed", F.col("mask").alias("item_mask"), F.col("at").alias("item_at"), "item", "item_words",
        F.least(F.lit(WINDOW), n).alias("window"),
        F.when(n < WINDOW, 0).otherwise(MAX_SUBSTITUTIONS).alias("most"),
    )
    # about BLOCK_BYTES in all: only words around the seed travel with it
    wanted = wanted.select(
        "seed",
        "item_mask",
        "item",
        "window",
        "most",
        F.least(F.lit(WINDOW - 1), "item_at").alias("item_lead"),
        F.slice(
            "item_words",
            F.greatest(F.lit(0), F.col("item_at") - (WINDOW - 1)) + 1,
            F.least(F.lit(WINDOW - 1), "item_at") + WINDOW,
        ).alias("item_near"),
    )
    hits = seeds(d, "words", "id", "text_key").join(F.broadcast(wanted), "seed").where("mask = item_mask")
    span = F.element_at(F.array(*(F.lit(m[-1] + 1) for m in MASKS)), F.col("mask") + 1)
    near = hits.withColumn("lead", F.least(F.lit(WINDOW) - span, "at", "item_lead")).withColumn(
        "length",
        F.col("lead")
        + F.least(F.lit(WINDOW), F.size("words") - F.col("at"), F.size("item_near") - F.col("item_lead")),
    )
    mine = F.slice("words", F.col("at") - F.col("lead") + 1, F.col("length"))
    theirs = F.slice("item_near", F.col("item_lead") - F.col("lead") + 1, F.col("length"))
    aligned = near.where(F.col("length") >= F.col("window")).select(
        "id",
        "text_key",
        "item",
        "window",
        "most",
        (F.col("at") - F.col("lead")).alias("from"),
        F.zip_with(mine, theirs, lambda x, y: (x != y).cast("int")).alias("differs"),
    )
    starts = F.filter(
        F.sequence(F.lit(0), F.size("differs") - F.col("window")),
        lambda s: F.aggregate(F.slice("differs", s + 1, F.col("window")), F.lit(0), lambda a, x: a + x) <= F.col("most"),
    )
    start = F.col("from") + F.col("offset")
    good = aligned.withColumn("offset", F.explode(starts))
    return good.select("id", "text_key", "item", start.alias("start"), (start + F.col("window")).alias("end"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, columns unchanged."""
    hit = stage(overlaps(docs, benchmark, id_col).select(F.col(id_col).alias("id"), "text_key").distinct(), "contaminated")
    return drop_rows(docs, hit, {"id": F.col(id_col), "text_key": F.xxhash64(whole_text())})
