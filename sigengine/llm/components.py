"""Connected components of an edge table by alternating stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigengine.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the smallest node it reaches."""
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    mark = None
    for _ in range(most_rounds):
        new = _mark(e)
        if new == mark:
            break
        mark = new
        hub = max(200, mark[0] // 500)  # edges of a node that is joined apart: there are at most 1,000 such nodes
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _joined(both, least, hub).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _joined(large, low, hub).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _joined(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """(u, v, m): the edges with what ``least`` (u, m, n) says of their first node; nodes of ``hub`` or more edges are few and are broadcast."""
    hubs = F.broadcast(least.filter(F.col("n") >= hub).select("u", F.col("m").alias("mh")))
    marked = edges.join(hubs, "u", "left")
    rest = marked.filter("mh IS NULL").select("u", "v").join(least.filter(F.col("n") < hub).select("u", "m"), "u")
    return rest.unionByName(marked.filter("mh IS NOT NULL").select("u", "v", F.col("mh").alias("m")))


def _mark(e: DataFrame) -> tuple:
    """Changes whenever the edges do."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.crc32(F.concat_ws(",", "u", "v").cast("binary"))), F.bit_xor(F.xxhash64("u", "v"))).first())
