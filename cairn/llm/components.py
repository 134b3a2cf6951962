"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialise, release


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Of edges (u, v): a row (node, component) for every node of an edge, component being the smallest node it reaches.

    Alternates large-star and small-star steps: each node's larger, then smaller, neighbours are hung onto the smallest node
    known, until every node hangs on one that hangs on none; the number of rounds grows as the logarithm of the longest path. The
    smallest neighbour comes from an aggregation that combines on the map side and is joined back, so a node with very many
    neighbours is never gathered in a list. Each round is checkpointed. Loops and repeated edges are harmless; no edges give no rows.
    If `rounds` rounds don't finish the labels, RuntimeError is raised.
    """
    e = materialise(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for k in count():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.bool_or(F.col("v") > F.col("u")).alias("above"))
        if least.where("below > 1 or (below = 1 and above)").isEmpty():
            break
        if k >= rounds:
            raise RuntimeError(f"components are not finished after {rounds} rounds")
        large = both.where("v > u").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        del both, least, large, small
        release(e.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
