"""Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups, and a proof for every row.

The rows of a group are numbered in key order and cut into aligned blocks of 1,024. A block keeps each of its ten levels as
one string of hexadecimal digests; substrings of two digests' width are hashed to the level above. The digest left over at
the top stands for the block among the nodes of the next round, which are cut into blocks again, until a group has one
block. On the way down, every node's siblings are the substrings beside its own in the strings of its block; a block hands
the siblings of the rounds above to all of its nodes. Groups (nulls first) are the leaves of one more such tree.

Levels are binary columns holding the hexadecimal text, as ``substring`` reaches any place of those without counting
characters. Everything is DataFrame functions: rows are range-partitioned, so neither a group nor a key that holds most of
the table comes into one task; joins are between single rows per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.session import cut_lineage

#: Levels of a block; it has two to the power of this many nodes.
LEVELS = 10
DIGEST = 64


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 length, a colon and its text."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
                             for c in (f.cast("string") for f in fields)]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(path: Column) -> Column:
    """Siblings of a path as one string, level by level and left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _place(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos`` (from 0, in ``order`` inside ``group``) and ``n``, the group's size."""
    sorted_rows = cut_lineage(nodes.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
                              .withColumn("row", F.monotonically_increasing_id()))
    rows = sorted_rows.withColumn("part", F.shiftrightunsigned("row", 33))
    runs = rows.groupBy("group", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy("group")
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("group", "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("rows").over(group).alias("n"))
    return rows.join(shifts, ["group", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _parents(level: Column) -> Column:
    last = F.floor((F.octet_length(level) - DIGEST) / (2 * DIGEST)).cast("int")
    pair = lambda i: F.sha2(F.substring(level, i * (2 * DIGEST) + 1, F.lit(2 * DIGEST)), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), last), pair), "").cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of ``nodes`` (group, pos, n, digest, item) with all their levels and the digest on top."""
    block = F.shiftright("pos", LEVELS)
    rows = nodes.groupBy("group", block.alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", "item"))).alias("items"))
    depth = F.when(F.col("n") > 1 << LEVELS, LEVELS).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    ground = F.array(F.array_join(F.transform("items", lambda x: x["digest"]), "").cast("binary"))
    steps = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), depth.cast("int"))
    levels = F.aggregate(steps, ground, lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))
    return cut_lineage(rows.withColumn("levels", levels)).withColumn("top", F.element_at("levels", -1).cast("string"))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Block tables from the nodes up to one block per group. One figure, the largest group's size, comes to the driver."""
    nodes = cut_lineage(nodes)
    largest = nodes.agg(F.max("n")).first()[0] or 0
    found = [_blocks(nodes)]
    while largest > 1 << LEVELS:
        largest = -(-largest >> LEVELS)
        upper = found[-1].select("group", F.col("block").alias("pos"), F.shiftright(F.col("n") + ((1 << LEVELS) - 1), LEVELS).alias("n"),
                                 F.col("top").alias("digest"), F.struct().alias("item"))
        found.append(_blocks(upper))
    return found


def _siblings(place: Column) -> Column:
    """The digests beside the node at ``place`` on every level of its block but the top."""
    below_top = F.slice("levels", F.lit(1), F.size("levels") - 1)

    def beside(level: Column, k: Column) -> Column:
        at = F.call_function("shiftright", place, k)
        odd = F.pmod(at, F.lit(2)) == 1
        other = F.substring(level, (at + F.when(odd, -1).otherwise(1)) * DIGEST + 1, F.lit(DIGEST)).cast("string")
        return F.struct(F.when(odd, other).otherwise("").alias("left"), F.when(odd, "").otherwise(other).alias("right"))

    return F.transform(below_top, beside)


def _descend(rounds: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """``item``, ``digest``, ``path`` and the other columns of ``above`` (group, pos 0, path, ...) for every node of the lowest round."""
    extra = [c for c in above.columns if c not in ("group", "pos", "path")]
    for blocks in reversed(rounds):
        joined = blocks.join(above.select("group", F.col("pos").alias("block"), F.col("path").alias("upper"), *extra), ["group", "block"])
        nodes = F.transform("items", lambda x, i: F.struct(x["pos"].alias("pos"), x["digest"].alias("digest"), x["item"].alias("item"),
                                                           _siblings(i).alias("own")))
        above = joined.select("group", "upper", *extra, F.inline(nodes)).select(
            "group", "pos", "digest", "item", F.concat("own", "upper").alias("path"), *extra)
    return above


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``leaf``, ``subroot``, ``root``, ``path`` and the columns named in ``carry``.

    ``path`` lists the siblings from the leaf to the root as structs of ``left`` and ``right``; both are empty where a node
    has none. A group's rows ascend by key, nulls first; equal keys by their digests. A null group is a group of its own,
    before all others. Repeated rows are leaves of their own. A group of one row has its leaf as subroot, and a table of one
    group has its subroot as root. An empty table gives no rows. Other columns of ``docs`` aren't read, whatever their names.
    """
    carry = carry or {}
    place = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = cut_lineage(docs.select(place.alias("group"), F.col(key).alias("key"), digest([F.col(f) for f in fields]).alias("digest"),
                                     F.struct(*[c.alias(n) for n, c in carry.items()]).alias("carried"),
                                     # Tells repeated rows apart, so that they can be spread.
                                     F.monotonically_increasing_id().alias("twin")))
    nodes = _place(leaves, ["key", "digest", "twin"]).select("group", "pos", "n", "digest", F.struct("key", "carried").alias("item"))
    rounds = _rounds(nodes)
    subroots = rounds[-1].select(F.lit("").alias("group"), F.col("group").alias("member"), F.col("top").alias("digest"))
    upper = _rounds(_place(subroots, ["member"]).select("group", "pos", "n", "digest", F.struct("member").alias("item")))
    top = upper[-1].select("group", F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<left:string,right:string>>").alias("path"),
                           F.col("top").alias("root"))
    groups = cut_lineage(_descend(upper, top).select(F.col("item.member").alias("group"), F.lit(0).cast("long").alias("pos"), "path", "root",
                                                     F.col("digest").alias("subroot")))
    return _descend(rounds, groups).select(F.col("item.key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path",
                                           *[F.col(f"item.carried.{n}").alias(n) for n in carry])
