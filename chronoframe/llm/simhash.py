"""SimHash near-duplicate detection with a vantage-point tree over fingerprints.

Tree.  The 64 bits are cut into 16 slices.  Level s of the tree partitions the
fingerprints by their Hamming distance, on slice s, to a vantage point.  The
triangle inequality bounds the distance of two fingerprints on that slice from
below by the difference of their distances to the vantage point; the slices do
not overlap, so the bounds of successive levels add up.  A search of radius r
prunes a branch as soon as the bounds on its path sum to more than r and visits
the remaining leaves, its own and the boundary-overlapping ones.

The tree is a formula (vantage point, depth), so nothing is fitted, collected
or broadcast.  Its depth follows the number of distinct fingerprints.  A leaf
is a shuffle key (a shard): fingerprints live in one leaf and visit others; a leaf
that stays large (a dense ball of near copies) is cut into blocks whose pairs
of blocks are compared by separate tasks.  Inside a task every member is
compared exactly, by XOR and bit count, with all members and visitors, and only
a spanning forest of the links found leaves the task.  Components of these
links are then contracted across tasks (``components``).
"""

from __future__ import annotations

import math
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from chronoframe.llm.common import free_name, map_arrow, stage, utf8, whole_text
from chronoframe.llm.components import components
from chronoframe.llm.line_dedup import drop_rows

SEED = 42
SLICES, SLICE_BITS = 16, 4
VANTAGE = xxhash.xxh64_intdigest(b"vantage point", SEED)
# mean number of leaves that random fingerprints spread over, per level:
# 1 / sum over d of (C(4,d)/16)^2
SPREAD = 256 / 70
LEAF = 512  # distinct fingerprints aimed at per leaf
MEMBERS, VISITORS = 4096, 65536  # largest block of a leaf in one task
PAIRS = 1 << 20  # pairs compared at once
HASHES = 1 << 16  # shingle hashes whose bits are summed at once
VISITS = 1 << 20  # rows that one task makes of its fingerprints, about


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text (no words: 0)."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, HASHES):
        part = hashes[i : i + HASHES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint_udf(shingle: int):
    """Vectorised UDF: text column to signed 64-bit fingerprint."""

    @arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        out = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64)
        return pa.array(out.view(np.int64))

    return fingerprints


def tree_depth(distinct: int) -> int:
    """Levels that bring a leaf down to about ``LEAF`` fingerprints."""
    return min(SLICES, max(0, math.ceil(math.log(max(1, distinct) / LEAF) / math.log(SPREAD))))


def profile(fp: np.ndarray, depth: int) -> np.ndarray:
    """Distance of each fingerprint to the vantage point on the first slices."""
    away = fp ^ np.uint64(VANTAGE)
    cut = [(away >> np.uint64(SLICE_BITS * s)) & np.uint64(2**SLICE_BITS - 1) for s in range(depth)]
    return np.stack([np.bitwise_count(c) for c in cut], axis=1).astype(np.int8) if depth else np.zeros((len(fp), 0), np.int8)


def detours(depth: int, radius: int) -> np.ndarray:
    """Profile changes within the triangle bounds, each unordered pair of leaves once."""
    out: list[tuple[int, ...]] = []

    def walk(prefix: tuple[int, ...], left: int) -> None:
        if len(prefix) == depth:
            first = next((d for d in prefix if d), 0)
            if first > 0:
                out.append(prefix)
            return
        for d in range(-left, left + 1):
            walk(prefix + (d,), left - abs(d))

    walk((), radius)
    return np.array(out, dtype=np.int8).reshape(len(out), depth)


def visits(fps: DataFrame, depth: int, radius: int, distinct: int) -> DataFrame:
    """(leaf, fp, home): a fingerprint's own leaf and the others it must visit.

    A few small files hold very many fingerprints, and each makes dozens of rows: the
    ``distinct`` fingerprints are dealt to so many tasks that none makes much more than ``VISITS``.
    """
    change = detours(depth, radius)
    tasks = -(-distinct * (1 + len(change)) // VISITS)
    if tasks > 1:
        fps = fps.repartition(tasks, "fp")
    weight = 5 ** np.arange(depth, dtype=np.int64)

    def place(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            prof = profile(fp.view(np.uint64), depth)
            own = prof.astype(np.int64) @ weight
            leaves, who, home = [own], [fp], [np.ones(len(fp), bool)]
            for step in change:
                to = prof + step
                ok = ((to >= 0) & (to <= SLICE_BITS)).all(axis=1)
                leaves.append(own[ok] + step.astype(np.int64) @ weight)
                who.append(fp[ok])
                home.append(np.zeros(int(ok.sum()), bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (leaves, who, home)], names=["leaf", "fp", "home"]
            )

    return map_arrow(fps.select("fp"), place, "leaf long, fp long, home boolean")


def forest(members: np.ndarray, everyone: np.ndarray, radius: int) -> np.ndarray:
    """Index of a smaller linked fingerprint of ``everyone`` for each (itself: none).

    ``members`` are the first entries of ``everyone``.
    """
    root = np.arange(len(everyone))
    step = max(1, PAIRS // max(1, len(everyone)))
    for i in range(0, len(members), step):
        near = np.bitwise_count(members[i : i + step, None] ^ everyone[None, :]) <= radius
        x, y = np.nonzero(near)
        x += i
        while True:
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                break
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def link_fingerprints(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, root) for the distinct fingerprints ``fps``: root names the component.

    Fingerprints are linked when they differ in at most ``max_bits`` bits.
    """
    distinct = fps.count()
    seen = visits(fps, tree_depth(distinct), max_bits, distinct)
    sizes = seen.groupBy("leaf").agg(F.count_if("home").alias("m"), F.count(F.lit(1)).alias("n"))
    large = sizes.where((F.col("m") > MEMBERS) | (F.col("n") > VISITORS)).select(
        "leaf",
        F.ceil(F.col("m") / MEMBERS).cast("int").alias("k"),
        F.ceil(F.col("n") / VISITORS).cast("int").alias("j"),
    )
    cut = seen.join(large, "leaf", "left").select(
        "leaf", "fp", "home", F.coalesce("k", F.lit(1)).alias("k"), F.coalesce("j", F.lit(1)).alias("j")
    )
    # a block holds members of one hash class and visitors of another: members go to every visitor
    # class, visitors (members of other classes too) to every member class
    own = F.pmod(F.xxhash64(F.lit("m"), "fp"), F.col("k")).cast("int")
    col = F.pmod(F.xxhash64(F.lit("v"), "fp"), F.col("j")).cast("int")
    spread = cut.withColumn("own", own).withColumn("col", col)
    as_member = spread.where("home").withColumn("block", F.col("own")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("j") - 1))
    )
    as_visitor = (
        spread.withColumn("part", F.col("col"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .where("not home or block > own")
    )
    cols = ["leaf", "block", "part", "fp"]
    blocks = as_member.select(*cols, F.lit(True).alias("member")).unionByName(
        as_visitor.select(*cols, F.lit(False).alias("member"))
    )

    def links(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        member = table.column("member").to_numpy(zero_copy_only=False)
        members = fp[member]
        everyone = np.concatenate([members, fp[~member]])
        root = forest(members, everyone, max_bits)
        linked = np.nonzero(root != np.arange(len(root)))[0]
        everyone = everyone.view(np.int64)
        return pa.table({"a": everyone[linked], "b": everyone[root[linked]]})

    found = blocks.groupBy("leaf", "block", "part").applyInArrow(links, "a long, b long")
    roots = components(found, "a", "b")
    return fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, ``fingerprint`` (hex) and ``component_id``.

    Words are runs of characters other than space and U+0009 to U+000D, with
    A-Z lower-cased.  NULL and wordless texts have fingerprint zero and are
    linked like any other.  ``component_id`` is the smallest id of the
    component (NULL only if all its ids are NULL).  Repeated rows each give a
    row; an empty table gives none; other columns are ignored.
    """
    rows = stage(docs.select(F.col(id_col), fingerprint_udf(shingle)(F.col("text")).alias("fp")), "simhash")
    per_fp = stage(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-distinct")
    linked = link_fingerprints(per_fp.select("fp"), max_bits).join(per_fp, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_per_component(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each near-duplicate component, the one of smallest id.

    Columns are unchanged.  NULL ids count as largest; among equal ids one row stays.
    """
    text_key = F.xxhash64(whole_text())
    rows = stage(
        docs.select(F.col(id_col).alias("id"), text_key.alias("key"), fingerprint_udf(shingle)(F.col("text")).alias("fp")),
        "simhash-rows",
    )
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    per_fp = stage(rows.groupBy("fp").agg(F.min(rank).alias("best")), "simhash-distinct")
    linked = link_fingerprints(per_fp.select("fp"), max_bits).join(per_fp, "fp")
    kept = linked.groupBy("root").agg(F.min("best").alias("best")).select("best.id", "best.key")
    kept = stage(kept, "simhash-kept")
    # a document is its id and text key; all but the kept ones go, and the copies of a kept one
    seen = rows.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("id").eqNullSafe(F.col("kid")) & (F.col("key") == F.col("kkey"))
    marked = seen.join(kept.select(F.col("id").alias("kid"), F.col("key").alias("kkey"), F.lit(True).alias("stays")), same, "left")
    marked = stage(marked.select("id", "key", "n", F.col("stays").isNotNull().alias("stays")), "simhash-marked")
    keys = {"id": F.col(id_col), "key": text_key}
    several = marked.where("stays and n > 1")
    out = drop_rows(docs, marked.where("not stays").unionByName(several), keys)
    if several.isEmpty():
        return out
    names = {k: free_name(docs, f"_key_{k}") for k in keys}
    copies = docs.withColumns({names[k]: v for k, v in keys.items()})
    again = copies.join(
        several.select(F.col("id").alias("sid"), F.col("key").alias("skey")),
        F.col(names["id"]).eqNullSafe(F.col("sid")) & (F.col(names["key"]) == F.col("skey")),
        "left_semi",
    )
    one = again.dropDuplicates(list(names.values())).select(*docs.columns)
    return out.unionByName(one)
