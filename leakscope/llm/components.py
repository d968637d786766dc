"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest node around: the larger ones, or the smaller ones and the node itself."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)``; the label is the smallest node reachable.

    The rounds grow with the logarithm of the longest path.  Minima are aggregated
    on the map side, and the join of a hot node can be split by AQE.  Self-links and
    repeated or reversed links do no harm; null ends are left out.
    """
    edges = stored(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        edges = stored(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
