"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a 64-bit ring.  A row's key hash falls
into the arc that ends at the next point clockwise.  Shards have a capacity;
a row whose shard is full continues clockwise to the next distinct shard.
With ``slack=0`` the capacities sum to the number of rows, so the shard counts
are at most one apart; a positive slack trades balance for fewer moves when
the number of shards changes.

Only counts per arc (``num_shards * vnodes`` numbers, whatever the data) reach
the driver.  There the rows of an arc are cut, in ring order, into rank ranges
that go to the arc's successive shards.  Rows find their rank inside the arc
in two levels (a cell of the arc, then the rank inside the cell), so a key
that holds a third of all rows is spread over ``SALTS`` cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chronoframe.llm.common import stage, whole_text

SLICES = 16  # position slices of an arc
SALTS = 1024  # cells that one key's rows are spread over


def ring_points(num_shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ring positions (signed 64-bit) and the shard that owns each."""
    pos = np.array(
        [xxhash.xxh64_intdigest(f"shard {s} node {v}", seed=42) for s in range(num_shards) for v in range(vnodes)],
        dtype=np.uint64,
    ).astype(np.int64)
    owner = np.repeat(np.arange(num_shards), vnodes)
    order = np.lexsort((owner, pos))
    return pos[order], owner[order]


def clockwise_shards(owner: np.ndarray, num_shards: int) -> np.ndarray:
    """For each arc, the distinct shards in the order they are met clockwise."""
    n = len(owner)
    out = np.empty((n, num_shards), dtype=np.int64)
    for a in range(n):
        seen = dict.fromkeys(owner[(a + k) % n] for k in range(n))
        out[a] = list(seen)
    return out


def fill_arcs(counts: np.ndarray, visit: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Cut each arc's rows into (arc, lo, hi, shard, first slot) rank ranges.

    Round r offers what is left of every arc to its r-th shard clockwise; a
    shard takes rows in arc order until it is full.  The work depends on the
    ring only, not on the number of rows.
    """
    left, at, used = counts.copy(), np.zeros_like(counts), np.zeros_like(capacity)
    ranges = []
    for r in range(visit.shape[1]):
        for arc in np.nonzero(left)[0]:
            shard = visit[arc, r]
            take = int(min(left[arc], capacity[shard] - used[shard]))
            if take > 0:
                ranges.append((int(arc), int(at[arc]), int(at[arc]) + take, int(shard), int(used[shard])))
                left[arc] -= take
                at[arc] += take
                used[shard] += take
    return ranges


def assign_shards(
    docs: DataFrame, num_shards: int = 16, vnodes: int = 128, slack: float = 0.0, id_col: str = "doc_id"
) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard``, ``slot``.

    The ring key is the text, so equal texts meet on one shard as long as it
    has room and overflow together clockwise.  NULL text: the empty text (size
    1).  NULL ids are rows like any other.  Repeated rows each get a slot of
    their own.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    pos, owner = ring_points(num_shards, vnodes)
    n_arcs = len(pos)
    text = whole_text()

    @pandas_udf("struct<arc:int,slice:int>")
    def place(key: pd.Series) -> pd.DataFrame:
        h = key.to_numpy()
        arc = np.searchsorted(pos, h, side="left") % n_arcs
        start = pos[arc - 1].astype(np.uint64)
        width = np.maximum((pos[arc].astype(np.uint64) - start) // np.uint64(SLICES), np.uint64(1))
        step = (h.astype(np.uint64) - start - np.uint64(1)) // width
        return pd.DataFrame({"arc": arc.astype(np.int32), "slice": np.minimum(step, SLICES - 1).astype(np.int32)})

    narrow = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.pmod(F.xxhash64(F.lit("salt"), F.col(id_col), text), F.lit(SALTS)).cast("int").alias("salt"),
    ).withColumn("at", place("key"))
    rows = stage(
        narrow.select(id_col, "size", "text_crc32", "key", F.col("at.arc"), F.col("at.slice"), "salt"), "ring-rows"
    )

    cell = ["arc", "slice", "salt"]
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    by_arc = Window.partitionBy("arc").orderBy("slice", "salt")
    before = F.sum("n").over(by_arc.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*cell, F.coalesce(before, F.lit(0)).alias("before"))

    per_arc = rows.groupBy("arc").count().collect()  # at most num_shards * vnodes rows
    counts = np.zeros(n_arcs, dtype=np.int64)
    for r in per_arc:
        counts[r["arc"]] = r["count"]
    total = int(counts.sum())
    if slack > 0:
        capacity = np.full(num_shards, int(np.ceil((1 + slack) * total / num_shards)), dtype=np.int64)
    else:
        capacity = np.array([total // num_shards + (s < total % num_shards) for s in range(num_shards)])
    ranges = fill_arcs(counts, clockwise_shards(owner, num_shards), capacity)
    plan = spark.createDataFrame(ranges, "arc int, lo long, hi long, shard int, first_slot long")

    in_cell = F.row_number().over(Window.partitionBy(*cell).orderBy("key", id_col)) - 1
    ranked = rows.withColumn("in_cell", in_cell).join(cells, cell).withColumn("rank", F.col("before") + F.col("in_cell"))
    # the plan's size follows from the ring (arcs x shards), never from the data
    return (
        ranked.alias("r")
        .join(
            F.broadcast(plan.alias("p")),
            (F.col("r.arc") == F.col("p.arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
        )
        .select(
            F.col(id_col),
            "size",
            "text_crc32",
            "shard",
            (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot"),
        )
    )
