"""Connected components of a sparse graph, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Rounds after which a graph that still changes is an error; the number needed grows with the
#: logarithm of the longest chain.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from edges (a, b) of longs: root is the smallest node of node's component. Nodes
    without an edge to another node do not appear.

    Each round turns every node's edges to larger nodes towards its smallest neighbour (large star),
    then its edges to smaller ones (small star). Minima are aggregated partially before the shuffle,
    and the join that spreads them merges, with plain exchanges on both sides, so a node with many edges is
    split and nothing is sent through the driver. Each round is written to the shared folder, as the lineage would double otherwise; what the
    round before wrote goes."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = cut(large.distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low.hint("merge"), "u").select("u", "v", "m")
        turned = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, cut(turned.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        release(old, least, large, low)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
