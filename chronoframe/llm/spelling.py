"""Spelling variants: groups of words one edit apart, found in a frequency-vector trie.

A word's vector holds how many of its letters fall into each of ``GROUPS`` letter
groups (fixed by rule: a code point's place in a mixed order).  One inserted,
deleted or replaced letter changes the vector by at most one surplus and one
deficit, so the words one edit from a word lie at the leaves that a depth-first
search of the trie of vectors reaches with a budget of one each.

Each pair is found from one side: a search spends its deficit (a letter that the
stored word lacks) first and may then spend its surplus, so the longer word asks,
or of two equally long ones that with the larger count at the first difference.

The top of the trie is dealt out by Spark: the first ``TOP_LEVELS`` counts name a
subtree.  A word is stored in its own subtree and asks in every subtree that the
budget reaches from there.  Subtrees with more than ``SUBTREE_WORDS`` words go
deeper, some levels at a time, while there are levels; what is then still
larger (words of one vector) is cut into blocks of words that each question
visits.  A task builds the rest of a subtree's trie, searches it for every
question with the budget that is left, and verifies the words at the leaves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import map_arrow, stage, utf8

MIN_LENGTH = 5
MIN_COUNT = 3
DELETE_EACH = 97
GROUPS = 14  # letter groups, one trie level each
TOP_LEVELS = 8  # levels dealt out at once
SUBTREE_WORDS = 50_000  # words of one subtree or block
MAX_WORDS = 200_000  # distinct words a task holds while counting

RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}")  # whole runs; shorter ones give no word
UPPER = "".join(map(chr, range(65, 91)))
LOWER = str.maketrans(UPPER, UPPER.lower())


# ---- words -------------------------------------------------------------------


def spelled(begun: int, run: str) -> str:
    """The lower-cased run, without one letter if the hash says so; ``begun`` is the hash of the id and the colon."""
    h = zlib.crc32(run.encode(), begun)
    if h % DELETE_EACH:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str) -> DataFrame:
    """(word, n) of the words of ``MIN_LENGTH`` letters or more."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")
    ).where(F.length("text") > 0)

    def emit(counts):
        words = [w for w in counts if len(w) >= MIN_LENGTH]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"]
        )

    def count(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                begun = zlib.crc32(utf8(doc_id.as_py()) + b":")
                own = Counter(RUN.findall(text.as_py().translate(LOWER)))
                for run, n in own.items():  # one hash for all places of a run
                    word = spelled(begun, run)
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > MAX_WORDS:
                    yield emit(counts)
                    counts = {}
        yield emit(counts)

    return map_arrow(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- vectors and the top of the trie -----------------------------------------


def letter_group(code_point: int) -> int:
    """Group of a letter: a multiplicative order, so neighbours in the alphabet part."""
    return (code_point * 2654435761 >> 7) % GROUPS


def vector(word: str) -> list[int]:
    counts = [0] * GROUPS
    for c in word:
        counts[letter_group(ord(c))] += 1
    return counts


#: What a search has spent: nothing, a deficit (the stored word has a letter less), that and a surplus.
NOTHING, DEFICIT, BOTH = 0, 1, 2


def top_paths(counts: list[int], begin: int, end: int, spent: int):
    """(counts, spent) of the paths over levels ``begin`` to ``end`` within the budget."""
    if begin == end:
        yield (), spent
        return
    own = counts[begin]
    for more, after in ((0, spent), *(((-1, DEFICIT),) if spent == NOTHING and own else ((1, BOTH),) if spent == DEFICIT else ())):
        for rest, last in top_paths(counts, begin + 1, end, after):
            yield (own + more, *rest), last


STORED, ASKING = 0, 1


def deepen(rows: DataFrame, begin: int, end: int) -> DataFrame:
    """Rows moved from the subtrees at level ``begin`` to those at level ``end``."""

    def move(batches):
        for batch in batches:
            out = [], [], [], [], []
            for path, kind, word, n, spent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = vector(word)
                for more, last in top_paths(counts, begin, end, spent) if kind == ASKING else [(counts[begin:end], spent)]:
                    for column, value in zip(out, (path + "".join(f"{c}," for c in more), kind, word, n, last), strict=True):
                        column.append(value)
            kinds = pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32()
            arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "kind", "word", "n", "spent"])

    return map_arrow(rows, move, "path string, kind int, word string, n long, spent int")


def one_edit_apart(a: str, b: str) -> bool:
    """Whether ``a`` (not the shorter one) becomes ``b`` by one deleted or replaced letter."""
    i, m = 0, len(b)
    while i < m and a[i] == b[i]:
        i += 1
    if len(a) == m:
        return i < m and a[i + 1 :] == b[i + 1 :]
    return len(a) == m + 1 and a[i + 1 :] == b[i:]


# ---- subtrees ----------------------------------------------------------------


class Leaf:
    """Words of one vector: found by their first or last half, one of which an edit leaves alone."""

    def __init__(self):
        self.words: list[tuple[str, int]] = []
        self.halves: dict[int, dict[tuple[bool, str], list[tuple[str, int]]]] = {}

    def near(self, word: str):
        if len(self.words) <= 8:
            yield from (x for x in self.words if one_edit_apart(word, x[0]))
            return
        half = len(word) // 2
        tail = len(word) - half - 1  # letters after the half, without the changed one
        index = self.halves.get(len(word))
        if index is None:
            index = self.halves[len(word)] = {}
            for x in self.words:
                index.setdefault((True, x[0][:half]), []).append(x)
                index.setdefault((False, x[0][len(x[0]) - tail :]), []).append(x)
        for key in ((True, word[:half]), (False, word[len(word) - tail :])):
            for x in index.get(key, ()):
                if one_edit_apart(word, x[0]) and (key[0] or x[0][:half] != word[:half]):
                    yield x


def search(node, counts: list[int], level: int, spent: int):
    """(leaf, spent) within the budget, depth first."""
    if level == GROUPS:
        yield node, spent
        return
    own = counts[level]
    child = node.get(own)
    if child is not None:
        yield from search(child, counts, level + 1, spent)
    if spent == NOTHING:
        child = node.get(own - 1)
        if child is not None:
            yield from search(child, counts, level + 1, DEFICIT)
    elif spent == DEFICIT:
        child = node.get(own + 1)
        if child is not None:
            yield from search(child, counts, level + 1, BOTH)


def search_subtrees(rows: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for both sides of every pair one edit apart, from rows sorted by subtree and kind."""

    def pairs(batches):
        key, root, level = None, {}, 0
        for batch in batches:
            out = [], [], [], []
            for path, block, own_level, kind, word, n, spent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, block) != key:
                    key, root, level = (path, block), {}, own_level
                counts = vector(word)
                if kind == STORED:  # all of a subtree's words come before its questions
                    node = root
                    for c in counts[level : GROUPS - 1]:
                        node = node.setdefault(c, {})
                    if level < GROUPS:
                        leaf = node.get(counts[-1])
                        if leaf is None:
                            leaf = node[counts[-1]] = Leaf()
                    else:
                        leaf = root.setdefault("leaf", Leaf())
                    leaf.words.append((word, n))
                    continue
                found = search(root, counts, level, spent) if level < GROUPS else ((leaf, spent) for leaf in root.values())
                for leaf, last in found:
                    for other, m in leaf.near(word):
                        if last != NOTHING or word > other:  # one vector: the larger word asks
                            for column, two in zip(out, ((word, other), (n, m), (other, word), (m, n)), strict=True):
                                column += two
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())],
                names=["word", "n", "near", "near_n"],
            )

    return map_arrow(rows, pairs, "word string, n long, near string, near_n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of ``words`` (word, n) one edit apart, from both sides."""
    stored = words.select(F.lit("").alias("path"), F.lit(STORED).alias("kind"), "word", "n", F.lit(NOTHING).alias("spent"))
    rows, begin, settled = stored.unionByName(stored.withColumn("kind", F.lit(ASKING))), 0, []
    while True:
        end = min(GROUPS, begin + TOP_LEVELS)
        rows = stage(deepen(rows, begin, end), "spelling-subtrees")
        sizes = rows.where(F.col("kind") == STORED).groupBy("path").agg(F.count(F.lit(1)).alias("size"))
        rows = rows.join(sizes, "path")  # questions to subtrees that do not exist end here
        small = rows if end == GROUPS else rows.where(F.col("size") <= SUBTREE_WORDS)
        blocks = F.ceil(F.col("size") / SUBTREE_WORDS).cast("int")
        own = F.pmod(F.xxhash64("word"), blocks).cast("int")
        asked = F.when(F.col("kind") == STORED, F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1))
        settled.append(small.withColumns({"block": F.explode(asked), "level": F.lit(end)}).drop("size"))
        if end == GROUPS:
            break
        rows = stage(rows.where(F.col("size") > SUBTREE_WORDS).drop("size"), "spelling-large")
        if rows.isEmpty():
            break
        begin = end
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    dealt = found.repartition("path", "block").sortWithinPartitions("path", "block", "kind")
    return search_subtrees(dealt.select("path", "block", "level", "kind", "word", "n", "spent"))


# ---- forms and roots ---------------------------------------------------------


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) with ``root``: the last word on the way along the forms.

    A step at least doubles the count, so ways are short; each round doubles
    the steps that are taken at once.
    """
    at = stage(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        ahead = at.where("word != root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next")
        moved = stage(moved, "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("next is not null").isEmpty():
            return forms.join(at, "word")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", min_count: int = MIN_COUNT) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    Words are the runs of letters of the whole texts, A-Z lower-cased, less one
    letter where the hash of document id and run asks for it, of
    ``MIN_LENGTH`` letters or more and found ``min_count`` times or more.  A word's form
    is its near word of largest count (ties: first in code-point order) if that
    is at least twice its own; NULL otherwise.  NULL and empty texts have no
    words; a NULL id is hashed as the empty text; repeated rows count each time;
    texts of any length are read whole.  An empty table gives no rows; other
    columns are ignored.
    """
    words = stage(count_words(docs, id_col).where(F.col("n") >= min_count), "spelling-words")
    near = near_words(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    summed = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(summed, "word", "left")
    most = -F.col("best.less")
    larger = most >= F.col("n") * 2
    forms = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(larger, F.col("best.near")).alias("form"),
        F.when(larger, most).alias("form_n"),
    )
    return with_roots(stage(forms, "spelling-forms")).select("word", "n", "n_near", "form", "form_n", "root")
