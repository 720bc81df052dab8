"""Graphs stored as edge rows or path strings."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.session import cut_lineage


def neighbours(edges: DataFrame, node: str, direction: str = "out") -> DataFrame:
    """Children (``out``), parents (``in``) or both of one node."""
    out = edges.where(F.col("parent") == node).select(F.col("child").alias("node"))
    back = edges.where(F.col("child") == node).select(F.col("parent").alias("node"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def reach(edges: DataFrame, roots: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(node, hops)`` for everything reachable from ``roots(node)``, shortest hop count.

    Without ``max_hops`` it goes on until nothing new is found. Breadth first: visited nodes never re-enter, which also breaks cycles. Each level is
    checkpointed, so the plan does not grow with depth. ``edges`` is read once per level; store it
    first when it is derived from other tables.
    """
    level = cut_lineage(roots.select("node").distinct().withColumn("hops", F.lit(0)))
    levels = [level]
    links = edges.select(F.col("parent").alias("node"), "child")
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        visited = reduce(DataFrame.union, levels).select("node")
        found = links.join(level.select("node"), "node", "left_semi").select(F.col("child").alias("node")).distinct()
        level = cut_lineage(found.join(visited, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.union, levels)


def subtree(df: DataFrame, path: str, prefix: str, separator: str = "#") -> DataFrame:
    """The node at ``prefix`` and its descendants; ``A#B`` does not match ``A#BC``."""
    return df.where((F.col(path) == prefix) | F.col(path).startswith(prefix + separator))
