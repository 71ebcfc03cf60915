"""Connected components by repeated contraction, in DataFrame operations alone.

Each round every node hooks onto the smallest of itself and its neighbours; edges are rewritten to what their ends hooked
onto, and those within one node go. Stars collapse in one round, chains of nodes with hashed names shrink by a constant
factor. The minimum is partly aggregated before the shuffle and the rewriting joins can be split by AQE, so a node
with a third of all edges is no bottleneck. Every round is a written table; nothing but its emptiness reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.plans.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); nodes are connected if and only if their roots are equal.

    Loops and repeated edges, in either direction, make no difference; nulls name no node.
    """
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).where("node is not null").distinct()
    left = scratch.keep(edges.select("a", "b").where("a != b").select(lo, hi).distinct())
    hooks: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hook = scratch.keep(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")))
        hooks.append(hook)
        once = left.join(hook.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").select("pa", "b")
        twice = once.join(hook.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        was, left = left, scratch.keep(twice.where("a != b").select(lo, hi).distinct())
        scratch.drop(was)
    out = nodes.withColumn("root", F.col("node"))
    for hook in hooks:
        out = out.join(hook.select(F.col("node").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return scratch.keep(out)
