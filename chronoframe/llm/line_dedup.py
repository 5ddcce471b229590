"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words.  Two lines match at Jaccard similarity
``4/5`` or more; a line goes if a line before it (by document id, then line
number) matches it, judged on the input.  Lines without a token stay.

Steps, all built-in expressions:

1. Equal lines are grouped by 128 hash bits; all but the first go, and only
   first lines take part in what follows.
2. Tokens are ordered from rare to frequent.  Rarity comes from counts over
   all words in ``SLOTS`` hash slots (a fixed-size array); any fixed order gives
   the same matches, a good one short postings.
3. Prefix filter on keys of two neighbouring tokens.  Each token that only one
   of two lines has parts at most one pair of neighbours among their shared
   tokens, so matching lines of n and m tokens share a key at place (2n - m)/3 or
   before in the first and (2m - n)/3 or before in the second.  Two
   neighbours are far rarer than a token: their postings stay short as the
   corpus grows, where postings of single tokens grow with it.
4. Keys of one line are dropped.  Postings of up to ``SHORT`` lines are joined with
   themselves; in longer ones a line is first paired with the first line of its
   length class, so a large group of near copies costs one candidate a line and
   key, not all pairs.  Length and positional filters cut pairs inside the join,
   then a bound on the overlap from 128-bit token maps.
5. The whole token sets of the candidates are compared.
6. Lines that found no match and stand in longer postings are joined with all
   earlier lines of these postings; nothing is cut off.  Here the token maps are
   compared inside the join, and a pair leaves it at its first shared key only:
   lines that share a passage without being similar make no rows.
7. Documents that lost lines are rebuilt.

Steps 5 and 7 need the text of few lines or documents.  A bit array of fixed
size (``FILTER_BITS``, false positives only) thins the rows before the exact
join; when it fills up, more rows travel and the result is the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import drop_staged, free_name, stage, whole_text

NUM, DEN = 4, 5  # least Jaccard similarity
SLOTS = 1 << 18  # hash slots of the rarity counts
FILTER_BITS = 1 << 23
SHORT = 32  # lines of a posting whose pairs are all tried at once
MASK56 = (1 << 56) - 1
NO_ID = (1 << 63) - 1


# ---- fixed-size arrays as scalar subqueries ----------------------------------


def dense_array(values: DataFrame, size: int) -> Column:
    """(slot, value) rows as one array of ``size`` longs (missing: 0), a scalar subquery."""
    slots = values.sparkSession.range(size).select(F.col("id").alias("slot"))
    filled = slots.join(values, "slot", "left").select("slot", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = F.array_sort(F.collect_list(F.struct("slot", "value")))
    return filled.agg(F.transform(pairs, lambda p: p["value"]).alias("a")).scalar()


def membership(rows: DataFrame, keys: list[str]):
    """A function that tells whether a row's ``keys`` may occur in ``rows`` (no false negatives)."""
    slot = F.pmod(F.xxhash64(F.lit("filter"), *keys), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = rows.groupBy(F.shiftright(slot, 6).alias("slot")).agg(F.bit_or(bit).alias("value"))
    bits = dense_array(words, FILTER_BITS // 64)
    return F.get(bits, F.shiftright(slot, 6).cast("int")).bitwiseAND(bit) != 0


# ---- lines and tokens --------------------------------------------------------


def words_of(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    others = "\t\n\x0b\x0c\r"
    has_other = reduce(lambda x, y: x | y, (F.contains(text, F.lit(c)) for c in others))
    spaced = F.when(has_other, F.translate(text, others, " " * len(others))).otherwise(text)
    return F.array_remove(F.split(spaced, " "), "")


def slot_of(h: Column) -> Column:
    return h.bitwiseAND(SLOTS - 1)


def rarity(lines: DataFrame) -> Column:
    """Array of order classes by slot: two steps per doubling of the slot's word count, in the top bits."""
    words = lines.select(F.explode(F.split("line", " ")).alias("w")).select(F.xxhash64("w").alias("h"))
    counts = stage(words.groupBy(slot_of(F.col("h")).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "line-rarity")
    step = F.least(F.floor(F.log2("n") * 2).cast("long"), F.lit(127))
    return dense_array(counts.select("slot", F.shiftleft(step, 56).alias("value")), SLOTS)


def with_codes(lines: DataFrame, classes: Column) -> DataFrame:
    """``lines`` with ``t``: a line's distinct tokens as longs, sorted from rare to frequent."""
    classed = lines.withColumn("_classes", classes)  # referenced once: Catalyst inlines the subquery
    code = lambda h: F.get("_classes", slot_of(h).cast("int")).bitwiseOR(h.bitwiseAND(MASK56))
    hashes = F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w))
    return classed.withColumn("t", F.array_distinct(F.sort_array(F.transform(hashes, code)))).drop("_classes")


def similar_size(n: Column, m: Column) -> Column:
    return (F.least(n, m) * DEN) >= (F.greatest(n, m) * NUM)


def can_reach(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Positional filter: the first shared key at places i and j still allows the similarity.

    A line of n tokens has at most (5n - 4m)/9 that the other lacks.
    """
    spare = NUM + DEN
    return (
        (3 * i <= 2 * n - m)
        & (3 * j <= 2 * m - n)
        & ((i - j) * spare <= n * DEN - m * NUM)
        & ((j - i) * spare <= m * DEN - n * NUM)
    )


def prefix_keys(tokens: Column) -> Column:
    """Hashes of neighbouring tokens (the last one with an end mark) at the places where a first shared key may be."""
    n = F.size(tokens)
    places = F.floor((2 * n - F.ceil(n * NUM / DEN)) / 3).cast("int") + 1
    follower = F.slice(F.concat(tokens, F.array(F.lit(0).cast("long"))), F.lit(2), places)
    return F.zip_with(F.slice(tokens, F.lit(1), places), follower, lambda x, y: F.xxhash64(x, y))


def size_class(n: Column) -> Column:
    return F.floor(F.log(DEN / NUM, n.cast("double"))).cast("int")


# ---- the join ----------------------------------------------------------------


def _lines(docs: DataFrame) -> DataFrame:
    """(d, o, line): line order is (d, o)."""
    cut = docs.select("d", "tie", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return cut.select("d", F.shiftleft(F.col("tie"), 32).bitwiseOR(F.col("no").cast("long")).alias("o"), "line")


MAPS = ("w0", "w1")  # the two halves of a line's 128-bit token map


def token_map(tokens: Column, half: int) -> Column:
    """64 of 128 bits; a token flips the bit that seven of its hash bits name."""

    def flip(a: Column, x: Column) -> Column:
        place = F.shiftrightunsigned(x, 16).bitwiseAND(63).cast("int")
        flipped = a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
        return F.when(F.shiftrightunsigned(x, 22).bitwiseAND(1) == half, flipped).otherwise(a)

    return F.aggregate(tokens, F.lit(0).cast("long"), flip)


def _fits() -> Column:
    """Length and positional filters of a posting row and an earlier one (columns v...)."""
    n, vn = F.col("n"), F.col("vn")
    return similar_size(n, vn) & can_reach(n, F.col("i"), vn, F.col("vi"))


def _room() -> Column:
    """Whether the token maps of two lines (the other's columns v...) allow the similarity.

    Every bit in which the maps differ stands for a token that only one line
    has, so the overlap is at most half of what the sizes leave.
    """
    n, vn = F.col("n"), F.col("vn")
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(w).bitwiseXOR(F.col(f"v{w}"))) for w in MAPS))
    return (n + vn - apart) * (NUM + DEN) >= (n + vn) * (2 * NUM)


def _plausible(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Distinct pairs (d, o, vd, vo) whose token maps allow the similarity."""
    mine = firsts.select("d", "o", "n", *MAPS)
    other = mine.withColumnsRenamed({c: f"v{c}" for c in mine.columns})
    both = pairs.select("d", "o", "vd", "vo").distinct().join(mine, ["d", "o"]).join(other, ["vd", "vo"])
    return both.where(_room()).select("d", "o", "vd", "vo")


def _before(v: str) -> Column:
    return (F.col(f"{v}d") < F.col("d")) | ((F.col(f"{v}d") == F.col("d")) & (F.col(f"{v}o") < F.col("o")))


def _verified(pairs: DataFrame, lines: DataFrame, classes: Column) -> DataFrame:
    """Distinct (d, o) of the pairs whose lines match; pairs: d, o, vd, vo."""
    ends = pairs.select("d", "o").unionByName(pairs.select(F.col("vd").alias("d"), F.col("vo").alias("o")))
    wanted = lines.where(membership(ends, ["d", "o"]))
    tokens = with_codes(wanted, classes).select("d", "o", "t")
    other = tokens.select(F.col("d").alias("vd"), F.col("o").alias("vo"), F.col("t").alias("vt"))
    both = pairs.join(tokens, ["d", "o"]).join(other, ["vd", "vo"])
    shared = F.size(F.array_intersect("t", "vt"))
    match = shared * (NUM + DEN) >= (F.size("t") + F.size("vt")) * NUM
    return both.where(match).select("d", "o").distinct()


def _first_lines(lines: DataFrame, classes: Column) -> DataFrame:
    """The first of each group of equal lines that hold a token: keys, place, size, prefix keys and token maps."""
    n = F.size("t")
    prefix = prefix_keys(F.col("t"))
    maps = [token_map(F.col("t"), half).alias(name) for half, name in enumerate(MAPS)]
    coded = with_codes(lines, classes).select(
        *_line_keys(), F.struct("d", "o", n.alias("n"), prefix.alias("p"), *maps).alias("s")
    )
    firsts = coded.groupBy("k1", "k2").agg(F.min("s").alias("s"))
    # the size is tested on the result: below it, the tokens would be computed once more for the test
    return firsts.select("k1", "k2", "s.*").where(F.col("n") > 0)


def _line_keys() -> list[Column]:
    return [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("line"), "line").alias("k2")]


POSTING = ["key", "d", "o", "n", "i"]


def _postings(firsts: DataFrame) -> DataFrame:
    """Rows of keys that two lines or more share, with ``c``: the lines of the key."""
    postings = firsts.select("d", "o", "n", F.posexplode("p").alias("i", "key"))
    counted = postings.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return counted.where(F.col("c") > 1).select(*POSTING, "c")


def _earlier(rows: DataFrame) -> DataFrame:
    return rows.select(*POSTING).withColumnsRenamed({c: f"v{c}" for c in POSTING})


def _earlier_pairs(rows: DataFrame, others: DataFrame) -> DataFrame:
    same_key = F.col("key") == F.col("vkey")
    return rows.join(_earlier(others), same_key & _before("v") & _fits()).select("d", "o", "vd", "vo")


def _first_pairs(short: DataFrame, longer: DataFrame) -> DataFrame:
    """All pairs of short postings; in longer ones, lines with the first line of their length class."""
    classed = longer.withColumn("class", size_class(F.col("n")))
    leaders = classed.groupBy("key", "class").agg(F.min(F.struct("d", "o", "n", "i")).alias("v"))
    leaders = leaders.select("key", "class", *[F.col(f"v.{c}").alias(f"v{c}") for c in ("d", "o", "n", "i")])
    led = classed.join(leaders, ["key", "class"]).where(_before("v") & _fits())
    return _earlier_pairs(short, short).unionByName(led.select("d", "o", "vd", "vo"))


def _rivals(longer: DataFrame, near: DataFrame, firsts: DataFrame) -> DataFrame:
    """Posting rows of the keys that a line outside ``near`` has, with ``met``, prefix keys and token maps."""
    tagged = longer.join(near.withColumn("met", F.lit(True)), ["d", "o"], "left")
    keys = tagged.where(F.col("met").isNull()).select("key").distinct()
    return tagged.join(keys, "key", "left_semi").join(firsts.select("d", "o", "p", *MAPS), ["d", "o"])


def _rest_pairs(rivals: DataFrame) -> DataFrame:
    """Lines without ``met`` and all earlier lines of a key, each pair at the first key that it shares.

    All filters stand in the join, so only pairs to compare leave it.  If an
    earlier key is shared, the pair was tried there: its posting is either short or
    in ``rivals``.
    """
    columns = [*POSTING, "p", *MAPS]
    other = rivals.select(*columns).withColumnsRenamed({c: f"v{c}" for c in columns})
    known = F.arrays_overlap(F.slice("p", F.lit(1), F.col("i")), F.slice("vp", F.lit(1), F.col("vi")))
    same_key = F.col("key") == F.col("vkey")
    mine = rivals.where(F.col("met").isNull())
    return mine.join(other, same_key & _before("v") & _fits() & _room() & ~known).select("d", "o", "vd", "vo")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Distinct (d, o) of the lines that go; ``docs`` has d, tie, text, each document once."""
    lines = _lines(docs)
    classes = rarity(lines)
    firsts = stage(_first_lines(lines, classes), "line-firsts")

    # equal lines: all lines against the first of their kind
    first = firsts.select("k1", "k2", F.col("d").alias("vd"), F.col("o").alias("vo"))
    equal = lines.select(*_line_keys(), "d", "o").join(first, ["k1", "k2"]).where(_before("v")).select("d", "o")
    equal = stage(equal, "line-equal")

    work = stage(_postings(firsts), "line-postings")
    short, longer = work.where(F.col("c") <= SHORT), work.where(F.col("c") > SHORT)
    pairs = stage(_plausible(_first_pairs(short, longer), firsts), "line-pairs")
    near = stage(_verified(pairs, lines, classes), "line-near")
    drop_staged(pairs)

    # lines without a match yet against all earlier lines of their longer postings
    rivals = stage(_rivals(longer, near, firsts), "line-rivals")
    drop_staged(work, firsts)
    rest = stage(_rest_pairs(rivals), "line-rest")
    far = _verified(rest, lines, classes)
    repeats = stage(equal.unionByName(near).unionByName(far).distinct(), "line-repeats")
    drop_staged(equal, near, rivals, rest)
    return repeats


def order_keys(docs: DataFrame, id_col: str = "doc_id") -> tuple[Column, Column]:
    """What documents are ordered by: the id (NULL last), then 31 hash bits of the text."""
    tie = F.shiftrightunsigned(F.xxhash64(whole_text()), 33)
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), tie


def drop_rows(docs: DataFrame, losers: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows whose ``keys`` (name: value; NULL equals NULL) stand in ``losers``.

    Only rows that the bit array flags meet ``losers`` in a join; the text of all
    others stays where it is.
    """
    names = {k: free_name(docs, f"_key_{k}") for k in keys}
    gone = losers.select(*[F.col(k).alias(f"{names[k]}r") for k in keys]).distinct()
    keyed = docs.withColumns({names[k]: value for k, value in keys.items()})
    flagged = membership(losers.select(*[F.col(k).alias(names[k]) for k in keys]), list(names.values()))
    same = reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names.values()))
    unsure = keyed.where(flagged).join(gone, same, "left_anti")
    return keyed.where(~flagged).unionByName(unsure).select(*docs.columns)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without repeated lines, with columns ``n_lines`` and ``n_removed``.

    The text holds the lines kept, joined by line feeds; other columns are
    unchanged (an input column named ``n_lines`` or ``n_removed`` is replaced).
    NULL texts are one empty line and come back empty.  NULL ids
    come after all others.  Rows of equal id are ordered by 31 hash bits of their
    text; rows equal in id and these bits are one document and get the same
    result.  Texts and lines of any length are read whole.  An empty table gives
    no rows.  Ids must be integers.
    """
    id_value, text_tie = order_keys(docs, id_col)
    ids = docs.groupBy(id_value.alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    unique = ids.isEmpty()
    text = whole_text()
    tie = F.lit(0).cast("long") if unique else text_tie
    whole = docs.select(id_value.alias("d"), tie.alias("tie"), text.alias("text"))
    gone = repeated_lines(whole if unique else whole.distinct())

    d, t, numbers, split = (free_name(docs, c) for c in ("_d", "_tie", "_numbers", "_lines"))
    per_doc = gone.groupBy(F.col("d").alias(d), F.shiftright("o", 32).alias(t)).agg(
        F.collect_set(F.col("o").bitwiseAND((1 << 31) - 1).cast("int")).alias(numbers)
    )
    keyed = docs.withColumns({d: id_value, t: tie, "text": text})
    kept = [c for c in keyed.columns if c not in (d, t) and c.lower() not in ("n_lines", "n_removed")]
    hit = membership(per_doc, [d, t])
    # the lines are a column of two readers, which Spark does not inline: inside a lambda, split would run for every line
    lines = F.col(split)
    order = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers))
    rebuilt = F.array_join(F.transform(order, lambda i: F.get(lines, i)), "\n")
    touched = keyed.where(hit).join(per_doc, [d, t], "left").withColumn(split, F.split("text", "\n"))
    touched = touched.withColumns(
        {
            "n_lines": F.size(lines).cast("long"),
            "n_removed": F.coalesce(F.size(numbers), F.lit(0)).cast("long"),
        }
    ).withColumn("text", F.when(F.col(numbers).isNull(), F.col("text")).otherwise(rebuilt))
    n_lines = F.size(F.split("text", "\n")).cast("long")
    clean = keyed.where(~hit).withColumns({"n_lines": n_lines, "n_removed": F.lit(0).cast("long")})
    out = [*kept, "n_lines", "n_removed"]
    return touched.select(*out).unionByName(clean.select(*out))
