"""Document fingerprints by consistent weighted sampling.

A document is the multiset of its words: term t with weight w(t), its count.
For each of ``SAMPLES`` samples k every term draws r and c from a Gamma(2,1)
and beta from a uniform distribution, all fixed by a hash of (t, k), and then

    level = floor(ln w / r + beta)        ln a = ln c - r * (level - beta + 1)

The term of smallest a, with its level, is sample k.  Two documents agree on a
sample with probability equal to their generalised Jaccard similarity,
sum of min(w) over sum of max(w).

Everything is built-in expressions.  A document's words are hashed, sorted and
counted inside its row; the exploded terms meet only partial ``min`` aggregates,
so a task sends one row a document, whatever its length.  The smallest a and
the sample's identity share one long: ln a in fixed point above, 32 hash bits of
(term, k, level) below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import stage, whole_text

SAMPLES = 32
BUCKET_ROWS = 2000  # rows aimed at per id range
MAX_BUCKETS = 1024
NULL_BUCKETS = 16  # ranges of rows without an id
LOW32 = (1 << 32) - 1
FIXED = 1 << 24  # fixed-point steps of ln a
SHIFT = 64.0  # makes ln a positive: draws keep it above -64


def term_hashes(text: Column) -> Column:
    """Sorted hashes of the words (runs of characters other than space and U+0009 to U+000D)."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def run_ends(hashes: Column) -> Column:
    """Where each run of equal entries of a sorted array ends (exclusive)."""
    n = F.size(hashes)
    return F.when(
        n > 0,
        F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(hashes, i) != F.get(hashes, i - 1))),
    ).otherwise(F.array().cast("array<int>"))


def draw(term: Column, log_weight: Column, k: int) -> Column:
    """Sample k's long for one term: ln a in the upper half, the sample's identity below."""
    one, two = F.xxhash64(term, F.lit(k)), F.xxhash64(F.lit(k), term)
    u1 = (F.shiftrightunsigned(one, 43) + 0.5) / float(1 << 21)
    u2 = (F.shiftrightunsigned(one, 22).bitwiseAND((1 << 21) - 1) + 0.5) / float(1 << 21)
    beta = (one.bitwiseAND((1 << 22) - 1) + 0.5) / float(1 << 22)
    u3 = (F.shiftrightunsigned(two, 32) + 0.5) / float(1 << 32)
    u4 = (two.bitwiseAND(LOW32) + 0.5) / float(1 << 32)
    r = -F.ln(u1 * u2)
    log_c = F.ln(-F.ln(u3 * u4))
    level = F.floor(log_weight / r + beta)
    log_a = log_c - r * (level - beta + 1)
    fixed = F.floor((log_a + SHIFT) * float(FIXED))
    identity = one.bitwiseXOR(level * F.lit(0x9E3779B1)).bitwiseAND(LOW32)
    return F.shiftleft(fixed, 32).bitwiseOR(identity)


def signatures(rows: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``signature`` (array of ``samples`` ints); texts without words get zeros.

    Rows equal in ``keys`` must hold the same text; they give one row.
    """
    hashed = rows.select(*keys, term_hashes(F.col(text_col)).alias("_h"))
    ended = hashed.select(*keys, "_h", run_ends(F.col("_h")).alias("_e"))
    runs = ended.select(*keys, "_h", "_e", F.posexplode_outer("_e").alias("_j", "_end"))
    begin = F.when(F.col("_j") == 0, 0).otherwise(F.get("_e", F.col("_j") - 1))
    terms = runs.select(
        *keys, F.get("_h", F.col("_end") - 1).alias("_t"), F.ln((F.col("_end") - begin).cast("double")).alias("_w")
    )
    mins = [F.min(draw(F.col("_t"), F.col("_w"), k)).alias(f"_m{k}") for k in range(samples)]
    best = terms.groupBy(*keys).agg(*mins)
    entry = lambda k: (F.coalesce(F.col(f"_m{k}").bitwiseAND(LOW32), F.lit(0)) - (1 << 31)).cast("int")
    return best.select(*keys, F.array(*(entry(k) for k in range(samples))).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries: the estimate of the generalised Jaccard similarity."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda eq: eq)
    return F.size(same) / F.size(a)


def hex_signature(signature: Column) -> Column:
    """Eight lower-case hex digits per sample, joined."""
    digits = lambda x: F.lpad(F.lower(F.hex(x.cast("long") + (1 << 31))), 8, "0")
    return F.concat_ws("", F.transform(signature, digits))


def with_next_text(docs: DataFrame, id_col: str) -> DataFrame:
    """Rows in descending id, each with its place and the next row's text.

    Columns: id, text, ``bucket``, ``place`` (from 1 in the bucket),
    ``next_bucket``, ``next_place``, ``next_text``.  Equal ids follow each other by
    text hash, NULL ids come last, and after the last row comes the first.

    Ids are cut into ranges at approximate quantiles (at most ``MAX_BUCKETS``),
    so the order is found in parallel; the last row of a range takes the first
    text of the next range, of which there is one a range.
    """
    text = whole_text()
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    n = base.count()
    cuts = max(0, min(MAX_BUCKETS, n // BUCKET_ROWS) - 1)
    bounds: list[int] = []
    if cuts:
        shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
        bounds = base.agg(F.percentile_approx("id", shares, 10_000)).first()[0] or []
    ranges = sorted(set(bounds))
    above = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in ranges)), lambda b: b > F.col("id")))
    by_id = above if ranges else F.lit(0)
    by_key = F.shiftright(F.col("key"), 60) + (NULL_BUCKETS // 2 + len(ranges) + 1)
    base = base.withColumn("bucket", F.when(F.col("id").isNull(), by_key).otherwise(by_id).cast("int"))
    order = Window.partitionBy("bucket").orderBy(F.col("id").desc_nulls_last(), "key", "text")
    firsts = base.withColumn("place", F.row_number().over(order)).where("place = 1").select("bucket", "text")
    # one row a bucket
    around = Window.orderBy("bucket")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = firsts.select(
        F.col("bucket").alias("edge"),
        F.coalesce(F.lead("bucket").over(around), F.first("bucket").over(whole)).alias("edge_bucket"),
        F.coalesce(F.lead("text").over(around), F.first("text").over(whole)).alias("edge_text"),
    )
    placed = base.withColumns({"place": F.row_number().over(order), "follower": F.lead("text").over(order)})
    last = F.col("follower").isNull()
    joined = placed.join(edges, (F.col("bucket") == F.col("edge")) & last, "left")
    return joined.select(
        "id",
        "text",
        "bucket",
        "place",
        F.when(last, F.col("edge_bucket")).otherwise(F.col("bucket")).alias("next_bucket"),
        F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
        F.coalesce("follower", "edge_text").alias("next_text"),
    )


def fingerprint_with_edits(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has the last floor(n/2) code points replaced by the first as
    many (or all) of the next document in descending id (after the last: the
    first).  Columns: id, ``n_chars``, ``edited_sha256``, ``signature``,
    ``edited_signature``, ``near_edited``, ``near_next``.  NULL texts are empty;
    texts without words have equal fingerprints; NULL ids come last; repeated
    rows each give a row; an empty table gives none.  Other columns are ignored.  Ids must be integers.
    """
    placed = with_next_text(docs, id_col)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    place = ["id", "bucket", "place", "next_bucket", "next_place"]
    both = placed.select(
        *place, n.cast("long").alias("n_chars"), "text", edited.alias("edited")
    ).select(
        *place,
        "n_chars",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("edit"), F.col("text").alias("body"), F.lit("").alias("sha")),
                F.struct(F.lit(1).alias("edit"), F.col("edited").alias("body"), F.sha2("edited", 256).alias("sha")),
            )
        ).alias("v"),
    )
    flat = both.select(*place, "n_chars", "v.edit", "v.sha", "v.body")
    signed = stage(signatures(flat, [*place, "n_chars", "edit", "sha"], "body", samples), "cws")
    own = signed.where("edit = 0").select(*place, "n_chars", "signature")
    new = signed.where("edit = 1").select(
        "bucket", "place", F.col("sha").alias("edited_sha256"), F.col("signature").alias("edited_signature")
    )
    following = signed.where("edit = 0").select(
        F.col("bucket").alias("next_bucket"), F.col("place").alias("next_place"), F.col("signature").alias("_next")
    )
    full = own.join(new, ["bucket", "place"]).join(following, ["next_bucket", "next_place"])
    return full.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        "signature",
        "edited_signature",
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("_next")).alias("near_next"),
    )
