"""Stored Bloom filters: a mergeable prefilter before an exact membership join (C17).

A filter is a table with one row per block in use: ``block``, ``blocks`` and eight 64-bit words. A key falls into one block
and sets one bit in each of its words, so building is one grouped ``bit_or`` (combined on the map side), merging is another,
and probing is an equi-join on the block with no row of the filter read twice. The number of blocks is a power of two, so a
larger filter folds onto a smaller one. Blocks and bits come from the MD5 of the key's text, as other engines can compute.
Null keys are no members. Nothing is sized by a constant: give the expected number of keys and the rate of false positives.
"""

from __future__ import annotations

from functools import reduce
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
WORD_BITS = 64
NAMES = [f"w{i}" for i in range(WORDS)]


def false_positive_rate(keys: float, blocks: int) -> float:
    """Share of strangers a filter of ``blocks`` lets pass when it holds ``keys``: the mean over Poisson block loads."""
    load = keys / blocks
    if load > 512:
        return 1.0
    total, chance = 0.0, exp(-load)
    for held in range(int(load * 4) + 64):
        total += chance * (1 - (1 - 1 / WORD_BITS) ** held) ** WORDS
        chance *= load / (held + 1)
    return total


def blocks_for(keys: int, rate: float) -> int:
    """Smallest power of two of blocks that keeps the rate of false positives at ``rate`` or below."""
    if not 0 < rate < 1:
        raise ValueError("the rate of false positives lies between 0 and 1")
    blocks = 1
    while false_positive_rate(max(keys, 1), blocks) > rate:
        blocks *= 2
    return blocks


def _placed(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """``df`` with ``_block`` and ``_spots``, the 48 bits that name one bit per word."""
    part = lambda at: F.conv(F.substring("_digest", at, 12), 16, 10).cast("bigint")
    hashed = df.withColumn("_digest", F.md5(F.col(key).cast("string").cast("binary")))
    return hashed.withColumns({"_block": F.pmod(part(1), blocks), "_spots": part(13)}).drop("_digest")


def _bit(word: int) -> Column:
    return F.shiftright("_spots", 6 * word).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")


def build(members: DataFrame, key: str, blocks: int) -> DataFrame:
    """Filter over the non-null ``key`` values; repeated keys set the same bits."""
    one = F.lit(1).cast("bigint")
    placed = _placed(members.where(F.col(key).isNotNull()).select(key), key, F.lit(blocks).cast("bigint"))
    bits = [F.bit_or(F.call_function("shiftleft", one, _bit(i))).alias(NAMES[i]) for i in range(WORDS)]
    return placed.groupBy(F.col("_block").alias("block")).agg(*bits).withColumn("blocks", F.lit(blocks).cast("bigint"))


def merge(*filters: DataFrame) -> DataFrame:
    """One filter that knows the keys of all: larger ones are folded to the size of the smallest."""
    rows = reduce(DataFrame.unionByName, filters)
    sized = rows.withColumn("_least", rows.agg(F.min("blocks")).scalar())
    return (sized.groupBy(F.pmod("block", "_least").alias("block"), F.col("_least").alias("blocks"))
            .agg(*[F.bit_or(n).alias(n) for n in NAMES]).select("block", *NAMES, "blocks"))


def might_contain(df: DataFrame, key: str, stored: DataFrame) -> DataFrame:
    """Rows whose key the filter may hold: every row of a member, and strangers at the stated rate.

    A block matches a key at most once, so no row is repeated. Spark broadcasts the filter while its size is known to be
    small (64 bytes a block) and shuffles by block beyond; AQE then splits a block that a hot key crowds.
    """
    here = stored.select(F.col("block").alias("_at"), *[F.col(n).alias(f"_{n}") for n in NAMES])
    blocks = stored.agg(F.max("blocks")).scalar()
    hit = reduce(Column.__and__, [F.getbit(f"_{NAMES[i]}", _bit(i)) == 1 for i in range(WORDS)])
    placed = _placed(df.where(F.col(key).isNotNull()), key, blocks)
    return placed.join(here, F.col("_block") == F.col("_at")).where(hit).select(*[F.col(f"`{c}`") for c in df.columns])


def member_rows(df: DataFrame, members: DataFrame, key: str, stored: DataFrame) -> DataFrame:
    """Exact semi join behind the filter: strangers are gone before the join shuffles, members never are."""
    return might_contain(df, key, stored).join(members.select(key), key, "left_semi")


def quality(df: DataFrame, members: DataFrame, key: str, stored: DataFrame, rate: float) -> DataFrame:
    """One row: ``strangers``, ``false_negatives`` and ``within_rate`` over the distinct keys of ``df``.

    The measured rate may exceed the stated one by four standard deviations of a sample of so many strangers.
    """
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    passed = might_contain(keys, key, stored).withColumn("_passed", F.lit(1))
    known = members.select(key).distinct().withColumn("_member", F.lit(1))
    marked = keys.join(passed, key, "left").join(known, key, "left")
    stranger, through = F.col("_member").isNull(), F.col("_passed").isNotNull()
    counted = marked.agg(F.count_if(stranger).alias("strangers"), F.count_if(~stranger & ~through).alias("false_negatives"),
                         F.count_if(stranger & through).alias("_wrong"))
    bound = F.lit(rate) * F.col("strangers") + 4 * F.sqrt(F.lit(rate) * F.col("strangers"))
    return counted.select("strangers", "false_negatives", (F.col("_wrong") <= bound).alias("within_rate"))
