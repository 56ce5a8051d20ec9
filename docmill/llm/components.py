"""Connected components of a large edge table, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long; root is the least node of its component.

    Each round maps every node to its least neighbour or itself, follows that map twice, and relabels the edges; what
    is left is an ever smaller graph. Rounds grow with the logarithm of the longest path. Each round is written out.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    result = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "hooks")
        for _ in range(2):
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            hook = hook.join(up.hint("merge"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        hook = stored(hook, "hooks")
        step = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
        if result is None:
            result = hook
        else:
            result = stored(result.join(step.hint("merge"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        for end in ("a", "b"):
            left = left.join(step.withColumnRenamed("root", end).hint("merge"), end).drop(end).withColumnRenamed("up", end)
        left = stored(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return result if result is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
