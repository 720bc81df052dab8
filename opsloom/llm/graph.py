"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.session import cut_lineage

#: Edges that one task takes.
ROWS = 250_000


def stored(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` behind a checkpoint, in no more partitions than its number of rows asks for.

    Iterations over small tables would otherwise write a file for every shuffle partition, however few rows there are.
    """
    kept = cut_lineage(df)
    return kept.coalesce(1 + kept.count() // rows)


def _least(edges: DataFrame) -> DataFrame:
    """Each node with the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Larger neighbours of a node point at the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
    moved = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """A node and its smaller neighbours point at the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges`` (u, v); the root is the smallest node of its component.

    Edges may be repeated, reversed or loops; nulls are ignored. No step gathers the neighbours of a node: minima are
    partial aggregates, and the joins are on edges, which Spark splits when one node has many. The number of rounds grows
    with the logarithm of the component size; each is cut by a checkpoint.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    size = now.count()
    while True:
        parts = 1 + size // ROWS
        new = stored(_small_star(_large_star(now, parts), parts))
        new_size = new.count()
        # A star forest: every node points at its root, and a round changes nothing.
        if new_size == size and not new.exceptAll(now).take(1):
            break
        now, size = new, new_size
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
