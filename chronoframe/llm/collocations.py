"""Phrase collocations from depth-truncated suffix subtrees.

Texts are cut at punctuation and line ends into pieces, pieces into words; a suffix
is the run of up to ``DEPTH`` words at a place.  All counts are per language.

1. Words are counted.  A phrase counts ``min_count`` times only if each of its words
   does, so a bit filter of the frequent words cuts the suffixes.
2. Vertical partitioning: two-word prefixes are counted, by the hashes of their two
   words.  Prefixes under ``min_count`` open no subtree.  The others are the phrases
   of two words, and are dealt into groups that hold about ``BUDGET`` suffixes
   each; a prefix of more than ``BUDGET`` suffixes is extended to its full depth
   before it is dealt.
3. Each task sends its suffixes of three words or more, equal ones combined, to
   their groups: a suffix of two words would only count its prefix again.  If a
   frequent word shares its hash with another word, the counts of step 2 may be too
   high; suffixes of two words are then sent as well, and the subtrees count them.
4. A group is sorted and read once: the path from the root to the current leaf is
   all that a task holds of its subtree.  Leaf totals add up to the counts of the
   nodes above; only nodes of extended prefixes are summed over groups.
5. Candidates look up the counts of their parts by join; scores are exact decimals.

The two filters go to the tasks as bits, ``FILTER_BITS_PER_KEY`` a key.  Their
keys are counted first: beyond ``MAX_FILTER_KEYS`` a filter is left out, more
suffixes travel, and the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import map_arrow, stage

MIN_COUNT = 100
DEPTH = 5  # words of the longest phrase
TOP = 2000  # phrases reported for a language
BUDGET = 2_000_000  # suffixes of a group
MAX_FILTER_KEYS = 1 << 23
FILTER_BITS_PER_KEY = 16
BLOCK_WORDS = 1 << 20  # words handled together by a task
MAX_WORDS = 400_000  # distinct words that a task remembers
MAX_BIGRAMS = 1 << 22  # two-word prefixes counted together by a task
ID_BITS = 21  # of a task's word numbers
RANK_SLICES = 64

BREAK = b"\xff"  # no byte of UTF-8
SEP = "\x00"  # between the words of a stored phrase; words hold it as an escape
UPPER = bytes(range(65, 91))
NORMAL = bytes.maketrans(UPPER + b".,;:!?\n\x0b\x0c\r\t", UPPER.lower() + BREAK * 10 + b" ")


# ---- words -------------------------------------------------------------------


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, with ``BREAK`` between pieces."""
    if b"\x01" in text or b"\x00" in text:  # the separator must sort before all that words hold
        text = text.replace(b"\x01", b"\x01b").replace(b"\x00", b"\x01a")
    return text.translate(NORMAL).replace(BREAK, b" \xff ").split()


def shown(phrase):
    """A stored phrase as text (column)."""
    spaced = F.replace(phrase, F.lit(SEP), F.lit(" "))
    return F.replace(F.replace(spaced, F.lit("\x01a"), F.lit("\x00")), F.lit("\x01b"), F.lit("\x01"))


class BitFilter:
    """Set of 64-bit hashes that may hold others as well."""

    def __init__(self, hashes: np.ndarray):
        bits = 1 << max(6, int(len(hashes) * FILTER_BITS_PER_KEY - 1).bit_length())
        self.mask = np.uint64(bits - 1)
        marked = np.zeros(bits, bool)
        for place in self._places(hashes.astype(np.uint64)):
            marked[place] = True
        self.bits = np.packbits(marked, bitorder="little")

    def _places(self, h: np.ndarray):
        return (h & self.mask).astype(np.int64), ((h >> np.uint64(32)) & self.mask).astype(np.int64)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for place in self._places(h):
            out &= ((self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
        return out


class _Numbers(dict):
    """Words of one language to numbers; new words get the next number."""

    def __init__(self, lang: bytes, store: Vocabulary):
        self.lang, self.store = lang, store
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        store = self.store
        number = self[word] = len(store.words)
        store.words.append(word)
        store.langs.append(self.lang)
        store.new.append(xxhash.xxh3_64_intdigest(self.lang + b"\x00" + word))
        return number


class Vocabulary:
    """Words that a task has met, their hashes and whether they may be frequent."""

    def __init__(self, frequent: BitFilter | None):
        self.frequent = frequent
        self.words, self.langs, self.new = [b""], [b""], []
        self.hashes, self.kept = np.zeros(1, np.uint64), np.zeros(1, bool)
        self.by_lang: dict[bytes, _Numbers] = {}

    def numbers(self, lang: bytes, text: bytes) -> list[int]:
        own = self.by_lang.get(lang)
        if own is None:
            own = self.by_lang[lang] = _Numbers(lang, self)
        return [*map(own.__getitem__, tokens(text)), 0]

    def settle(self) -> None:
        """Hashes of the words met since the last call."""
        if self.new:
            h = np.array(self.new, np.uint64)
            self.hashes = np.concatenate([self.hashes, h])
            may = self.frequent.may_hold(h) if self.frequent else np.ones(len(h), bool)
            self.kept = np.concatenate([self.kept, may])
            self.new = []


def blocks(batches, frequent: BitFilter | None):
    """(vocabulary, word numbers) of whole rows (lang, text); 0 stands between pieces."""
    vocabulary, held = Vocabulary(frequent), []
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            held += vocabulary.numbers(lang.as_py(), text.as_py())
            if len(held) >= BLOCK_WORDS:
                vocabulary.settle()
                yield vocabulary, np.array(held, np.int64)
                held = []
                if len(vocabulary.words) > MAX_WORDS:
                    vocabulary = Vocabulary(frequent)
    if held:
        vocabulary.settle()
        yield vocabulary, np.array(held, np.int64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


# ---- counts in tasks ---------------------------------------------------------


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, hash, n) of all words."""

    def count(batches):
        for vocabulary, numbers in blocks(batches, None):
            number, n = np.unique(numbers[numbers > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([vocabulary.langs[i] for i in number], pa.binary()).cast(pa.string()),
                    pa.array([vocabulary.words[i] for i in number], pa.binary()).cast(pa.string()),
                    pa.array(vocabulary.hashes[number].view(np.int64)),
                    pa.array(n.astype(np.int64)),
                ],
                names=["lang", "word", "hash", "n"],
            )

    part = map_arrow(rows, count, "lang string, word string, hash long, n long")
    return part.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.first("hash").alias("hash"))


def count_pairs(rows: DataFrame, frequent: BitFilter | None) -> DataFrame:
    """(first, second, n) of the two-word prefixes, by the hashes of their words."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def emit(vocabulary, held):
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        first, second = vocabulary.hashes[pair >> 32], vocabulary.hashes[pair & 0xFFFFFFFF]
        return pa.RecordBatch.from_arrays(
            [pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(n.astype(np.int64))],
            names=["first", "second", "n"],
        )

    def count(batches):
        held, size, of = [], 0, None
        for vocabulary, numbers in blocks(batches, shared.value):
            if held and (vocabulary is not of or size >= MAX_BIGRAMS):
                yield emit(of, held)
                held, size = [], 0
            of = vocabulary
            kept = vocabulary.kept[numbers]
            at = np.nonzero(kept[:-1] & kept[1:])[0]
            held.append((numbers[at] << 32) | numbers[at + 1])
            size += len(at)
        if held:
            yield emit(of, held)

    part = map_arrow(rows, count, "first long, second long, n long")
    return part.groupBy("first", "second").agg(F.sum("n").alias("n"))


def send_suffixes(
    rows: DataFrame, frequent: BitFilter | None, pairs: BitFilter | None, large: np.ndarray, depth: int, shortest: int
) -> DataFrame:
    """(lang, suffix, part, whole, n): suffixes of ``shortest`` (2 or 3) words or more, equal ones of a block combined.

    ``part`` deals rows into groups; ``whole`` says that all suffixes of the
    two-word prefix have the same ``part``.
    """
    shared = rows.sparkSession.sparkContext.broadcast((frequent, pairs, large))

    def send(batches):
        words_filter, pair_filter, extended = shared.value
        for vocabulary, numbers in blocks(batches, words_filter):
            padded = np.concatenate([numbers, np.zeros(depth, np.int64)])
            kept = vocabulary.kept[padded]
            linked = kept[:-1] & kept[1:]
            at = np.nonzero(linked)[0]
            h = pair_hashes(vocabulary.hashes[padded[at]], vocabulary.hashes[padded[at + 1]])
            if pair_filter is not None:
                may = pair_filter.may_hold(h)
                linked[at[~may]] = False
                at, h = at[may], h[may]
            if shortest > 2:
                longer = linked[at + 1]
                at, h = at[longer], h[longer]
            if not len(at):
                continue
            places = np.zeros((len(at), depth), np.int64)
            places[:, 0], places[:, 1] = padded[at], padded[at + 1]
            on = np.ones(len(at), bool)
            for k in range(2, depth):
                on = on & linked[at + k - 1]
                places[:, k] = np.where(on, padded[at + k], 0)
            keys = []
            for k in range(0, depth, 3):  # three word numbers to a key
                key = np.zeros(len(at), np.int64)
                for column in places[:, k : k + 3].T:
                    key = (key << ID_BITS) | column
                keys.append(key)
            order = np.lexsort(keys[::-1])
            new = np.ones(len(order), bool)
            new[1:] = np.any([key[order][1:] != key[order][:-1] for key in keys], axis=0)
            begin = np.nonzero(new)[0]
            n = np.diff(begin, append=len(order))
            pick = order[begin]
            h, places = h[pick], places[pick]
            whole = ~np.isin(h, extended)
            full = h.copy()
            for column in places[:, 2:].T:
                full = pair_hashes(full, vocabulary.hashes[column])
            part = np.where(whole, h, full).view(np.int64)
            words, langs = vocabulary.words, vocabulary.langs
            for a in range(0, len(pick), 1 << 16):
                some = places[a : a + (1 << 16)].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([langs[p[0]] for p in some], pa.binary()).cast(pa.string()),
                        pa.array([b"\x00".join([words[i] for i in p if i]) for p in some], pa.binary()).cast(pa.string()),
                        pa.array(part[a : a + (1 << 16)]),
                        pa.array(whole[a : a + (1 << 16)]),
                        pa.array(n[a : a + (1 << 16)].astype(np.int64)),
                    ],
                    names=["lang", "suffix", "part", "whole", "n"],
                )

    return map_arrow(rows, send, "lang string, suffix string, part long, whole boolean, n long")


def read_subtrees(sent: DataFrame, groups: int, min_count: int, shortest: int) -> DataFrame:
    """(lang, phrase, n) of the nodes of ``shortest`` words or more; a phrase may have several rows."""

    def read(batches):
        path: list[str] = []  # words from the root to the current leaf
        totals: list[int] = []
        lang, whole, out = None, True, ([], [], [])

        def close(depth):
            while len(path) > depth:
                n = totals.pop()
                if len(path) >= shortest and (n >= min_count or not whole):
                    for column, value in zip(out, (lang, SEP.join(path), n), strict=True):
                        column.append(value)
                path.pop()
                if totals:
                    totals[-1] += n

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())],
                names=["lang", "phrase", "n"],
            )
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for own, suffix, kept, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = suffix.split(SEP)
                same = 0
                if own == lang:
                    for x, y in zip(path, words, strict=False):
                        if x != y:
                            break
                        same += 1
                close(same)
                lang, whole = own, kept
                path += words[same:]
                totals += [0] * (len(path) - len(totals))
                totals[-1] += n
            yield flush()
        close(0)
        yield flush()

    dealt = sent.repartition(groups, "part").sortWithinPartitions("lang", "suffix")
    return map_arrow(dealt.select("lang", "suffix", "whole", "n"), read, "lang string, phrase string, n long")


# ---- the operator ------------------------------------------------------------


def _hashes(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    return [c.to_numpy().view(np.uint64) for c in rows.select(*columns).toArrow().columns]


def _ambiguous(words: DataFrame, common: DataFrame) -> bool:
    """Whether a word of ``common`` shares its hash with another word."""
    return words.join(common.select("hash"), "hash").count() > common.count()


def _two_words(prefixes: DataFrame, common: DataFrame) -> DataFrame:
    """(lang, phrase, k, a) of the prefixes."""
    first = common.select("lang", F.col("hash").alias("first"), F.col("word").alias("x"))
    second = common.select(F.col("hash").alias("second"), F.col("word").alias("y"))
    both = prefixes.join(first, "first").join(second, "second")
    return both.select("lang", F.concat_ws(SEP, "x", "y").alias("phrase"), F.lit(2).alias("k"), F.col("n").alias("a"))


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) of all phrases of 1 to ``depth`` words found ``min_count`` times, and (lang, n) of all words."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary")
    rows = docs.where(F.length("text") > 0).select(lang.alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    words = stage(count_words(rows), "phrase-words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = words.where(F.col("n") >= min_count)
    frequent = BitFilter(*_hashes(common, "hash")) if common.count() <= MAX_FILTER_KEYS else None
    shortest = 2 if _ambiguous(words, common) else 3

    prefixes = stage(count_pairs(rows, frequent).where(F.col("n") >= min_count), "phrase-prefixes")
    suffixes = prefixes.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-suffixes // BUDGET))
    pairs = BitFilter(pair_hashes(*_hashes(prefixes, "first", "second"))) if prefixes.count() <= MAX_FILTER_KEYS else None
    large = pair_hashes(*_hashes(prefixes.where(F.col("n") > BUDGET), "first", "second"))  # at most one a group
    sent = send_suffixes(rows, frequent, pairs, large, depth, shortest)
    spread = max(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = read_subtrees(sent, spread, min_count, shortest).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    k = F.length("phrase") - F.length(F.replace("phrase", F.lit(SEP), F.lit(""))) + 1
    phrases = nodes.where(F.col("a") >= min_count).select("lang", "phrase", k.cast("int").alias("k"), "a")
    single = common.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), F.col("n").alias("a"))
    if shortest > 2:
        phrases = phrases.unionByName(_two_words(prefixes, common))
    return stage(single.unionByName(phrases), "phrases"), sizes


def _exact(column, digits: int):
    return F.col(column).cast(f"decimal({digits},0)")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH, top: int = TOP, percent: int = 100
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Candidates are phrases of 2 to ``depth`` words found ``min_count`` times or
    more.  A cut after k words has score floor(1000 * a * n / (l * r)); the
    lowest counts, ties to the smallest k.  A candidate inside a longer one
    whose count is at least ``percent`` per cent of its own is dropped.  Order:
    score and ``a`` from high to low, then the phrase by its UTF-8 bytes, so ties
    are settled.  A NULL language is ``und``; NULL and empty texts have no words;
    texts are read whole, whatever their length; repeated rows and ids count
    each time (ids play no part).  An empty table gives no rows; other
    columns are ignored.
    """
    phrases, sizes = count_phrases(docs, min_count, depth)
    longer = phrases.where("k > 1")

    inside = (
        longer.where("k > 2")
        .select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
        .select("lang", "phrase", "k", "a", "m", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("m"))).alias("i"))
    )
    words = F.split("phrase", SEP)
    inside = inside.select("lang", F.array_join(F.slice(words, F.col("i") + 1, F.col("m")), SEP).alias("phrase"), "a")
    around = inside.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = longer.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * percent)
    )

    cuts = kept.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    part = lambda start, size: F.array_join(F.slice(words, start, size), SEP)
    left, right = part(F.lit(1), F.col("j")), part(F.col("j") + 1, F.col("k"))
    parts = phrases.select("lang", "phrase", "a")
    cuts = cuts.withColumns({"left": left, "right": right})
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    cuts = cuts.join(sizes, "lang").withColumn("a1000", F.col("a") * 1000)
    score = F.call_function("div", _exact("a1000", 19) * _exact("n", 18), _exact("l", 19) * _exact("r", 18))
    cuts = cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "j", "l", "r").alias("cut"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("cut").alias("cut"))
    scored = scored.select("lang", shown(F.col("phrase")).alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = scored.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SLICES)))
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order)))
    best = first.where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    out = ranked.where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
