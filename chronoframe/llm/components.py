"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import stage


def _mark(edges: DataFrame) -> tuple:
    """Row count and order-free checksum of an edge table."""
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node reachable.

    Each round links a node's larger neighbours to the smallest node it sees
    (large star), then its smaller neighbours likewise (small star), so paths
    shrink by a constant factor per round; a star is a fixed point.  Minima are
    partial aggregates and joins are keyed by node, so nothing about a
    component is ever gathered in one place.  Rounds are written to the shared
    checkpoint folder.
    """
    edges = stage(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(pulled.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
