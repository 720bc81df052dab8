"""Hash buckets every engine can reproduce: the first 32 bits of MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom.functions.timeutil import column


def stable_hash(key: str | Column) -> Column:
    """Unsigned 32-bit number from the key's text."""
    digest = F.md5(column(key).cast("string").cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def key_partition(key: str | Column, n: int) -> Column:
    """Partition of a record key: ``hash(key) % n``."""
    return F.pmod(stable_hash(key), F.lit(n)).cast("int")


def range_shard(key: str | Column, shards: int) -> Column:
    """Shard that owns the key's place in the 32-bit hash range."""
    return F.floor(stable_hash(key) * shards / F.lit(1 << 32)).cast("int")


def write_shard(key: str | Column, row_id: str | Column, shards: int) -> Column:
    """``key#n``: spreads one hot key over ``shards`` keys."""
    return F.concat_ws("#", column(key).cast("string"), key_partition(row_id, shards).cast("string"))


def base_key(sharded: str | Column) -> Column:
    """The key without its write-shard suffix."""
    return F.regexp_replace(column(sharded), "#[^#]*$", "")
