"""Sorted sets, version lists, ordered lists and event replay (E1-E15), paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.functions.ordered import first_n, global_position, position, running_sum
from opsloom.functions.timeutil import column

# A sorted set is rows of (member string, score).


def leaderboard(zset: DataFrame, n: int) -> DataFrame:
    """Highest scores first, equal scores by member descending; rank from 1."""
    leaders = zset.orderBy(F.desc("score"), F.desc("member")).limit(n)
    # Only the n leaders meet in the window.
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("member")))
    return leaders.withColumn("rank", rank)


def zranks(zset: DataFrame, reverse: bool = False) -> DataFrame:
    """Zero-based rank of every member."""
    order = [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]
    return global_position(zset, order, "rank")


def zrange(zset: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members by position, both ends included, negative positions from the end.

    Both positions from the same end need only a top-k; mixed ones number the whole set.
    """
    ascending, descending = [F.asc("score"), F.asc("member")], [F.desc("score"), F.desc("member")]
    order, backwards = (descending, ascending) if reverse else (ascending, descending)
    if 0 <= start <= stop:
        return zset.orderBy(*order).limit(stop + 1).offset(start)
    if start <= stop < 0:
        return zset.orderBy(*backwards).limit(-start).offset(-stop - 1)
    size = zset.agg(F.count(F.lit(1))).scalar()
    place = lambda i: F.lit(i) if i >= 0 else size + F.lit(i)
    return zranks(zset, reverse).where((F.col("rank") >= place(start)) & (F.col("rank") <= place(stop))).drop("rank")


def zrank(zset: DataFrame, member: str, reverse: bool = False) -> DataFrame:
    """Rank of one member by counting the rows before it: no sort, one pass after the lookup.

    No row when the set lacks the member.
    """
    own = zset.where(F.col("member") == member).agg(F.max("score")).scalar()
    here = F.struct("score", "member")
    target = F.struct(own.alias("score"), F.lit(member).alias("member"))
    ahead = here > target if reverse else here < target
    counted = zset.agg(F.count_if(ahead).alias("rank"), F.bool_or(F.col("member") == member).alias("_found"))
    return counted.where("_found").select("rank")


def zscore(zset: DataFrame, member: str) -> DataFrame:
    return zset.where(F.col("member") == member).select("score")


def zset_from_events(events: DataFrame, member: str, score: str | Column, order: Sequence[str], mode: str = "add") -> DataFrame:
    """``add`` sums increments, ``set`` keeps the last score."""
    value = column(score)
    agg = F.sum(value) if mode == "add" else F.max_by(value, F.struct(*order))
    return events.groupBy(F.col(member).cast("string").alias("member")).agg(agg.alias("score"))


def zrange_by_score(zset: DataFrame, low: float, high: float) -> DataFrame:
    return zset.where(F.col("score").between(low, high)).orderBy("score", "member")


def due(jobs: DataFrame, score: str, now: object) -> DataFrame:
    """Jobs whose time has come, oldest first."""
    return jobs.where(F.col(score) <= now).orderBy(score)


def zrem_by_score(zset: DataFrame, low: float, high: float) -> DataFrame:
    return zset.where(~F.col("score").between(low, high))


def zpop(zset: DataFrame, n: int, side: str = "min") -> tuple[DataFrame, DataFrame]:
    """The popped members and the remaining set."""
    order = ["score", "member"] if side == "min" else [F.desc("score"), F.desc("member")]
    popped = zset.orderBy(*order).limit(n)
    return popped, zset.join(popped.select("member"), "member", "left_anti")


def zcard(zset: DataFrame) -> DataFrame:
    return zset.agg(F.count(F.lit(1)).alias("n"))


def zcount(zset: DataFrame, low: float, high: float) -> DataFrame:
    return zset.agg(F.count_if(F.col("score").between(low, high)).alias("n"))


# --- latest rows ------------------------------------------------------------------------------

def latest_by(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest row per key as an aggregate: partial results shrink hot keys before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")).select(*keys, "_row.*")


def first_by(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*version)).alias("_row")).select(*keys, "_row.*")


def as_of(df: DataFrame, keys: Sequence[str], version: Sequence[str], moment: Column) -> DataFrame:
    """State at a point in time: later versions are ignored."""
    return latest_by(df.where(column(version[0]) <= moment), keys, version)


def keep_last(df: DataFrame, key: str, order: Sequence[str], row_id: str, n: int) -> DataFrame:
    """Newest ``n`` rows per key; exact where a trimmed log is only approximate."""
    return first_n(df, [key], [F.desc(c) for c in order], n, F.col(row_id), out="_rn").drop("_rn")


def lrange(df: DataFrame, key: str, order: Sequence[str], chunk: Column, start: int, stop: int) -> DataFrame:
    """List elements by position per key, negative positions from the end."""
    placed = position(df, [key], order, chunk, "pos", "_size")
    place = lambda i: F.lit(i) if i >= 0 else F.col("_size") + i
    return placed.where((F.col("pos") >= place(start)) & (F.col("pos") <= place(stop))).drop("_size")


# --- replay -----------------------------------------------------------------------------------

def replay(events: DataFrame, key: str, order: Sequence[str], amount: str, chunk: Column) -> DataFrame:
    """Balance after every event."""
    return running_sum(events, [key], order, chunk, {"balance": F.col(amount)})


def replay_final(events: DataFrame, key: str, amount: str) -> DataFrame:
    return events.groupBy(key).agg(F.sum(amount).alias("balance"))


def replay_from(snapshots: DataFrame, events: DataFrame, key: str, seq: str, amount: str) -> DataFrame:
    """Snapshot balance plus the events after the snapshot's sequence number."""
    marks = snapshots.select(key, F.col("snap_seq"), F.col("balance").alias("_base"))
    later = (events.join(marks, key, "left").where(F.col("snap_seq").isNull() | (F.col(seq) > F.col("snap_seq")))
             .groupBy(key).agg(F.sum(amount).alias("_later")))
    return (marks.join(later, key, "full_outer")
            .select(key, (F.coalesce("_base", F.lit(0)) + F.coalesce("_later", F.lit(0))).alias("balance")))


# --- order-statistics directory ---------------------------------------------------------------

class Ordered:
    """A table stored once in one total order, with a directory of how many rows each of its parts holds.

    The rows are range-partitioned and sorted; each partition is a folder. A position is found by the running counts of the
    directory (one row per part), and only the part or parts that hold it are opened, so a deep page costs what the first
    one does. Null order values come first in an ascending column and last in a descending one.
    """

    def __init__(self, spark: SparkSession, path: str, order: Sequence[tuple[str, bool]], schema: T.StructType) -> None:
        self.spark, self.path, self.order, self.schema = spark, path, list(order), schema

    @staticmethod
    def write(df: DataFrame, path: str, order: Sequence[tuple[str, bool]], parts: int | None = None) -> Ordered:
        """Store ``df``, ordered by (column, descending) pairs that tell all rows apart, in ``parts`` (default: Spark's)."""
        keys = [F.desc(c) if down else F.asc(c) for c, down in order]
        ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
        placed = ranged.withColumn("_part", F.spark_partition_id())
        placed.sortWithinPartitions("_part", *keys).write.partitionBy("_part").parquet(f"{path}/rows")
        stored = Ordered(df.sparkSession, path, order, df.schema)
        counts = stored._rows().groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
        upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        counts.withColumn("upto", F.sum("rows").over(upto)).coalesce(1).write.parquet(f"{path}/directory")
        return stored

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(f"{self.path}/rows")

    def directory(self) -> DataFrame:
        """``_part, rows, upto``: one row per part that has rows."""
        return self.spark.read.schema("_part int, rows bigint, upto bigint").parquet(f"{self.path}/directory")

    def size(self) -> int:
        """Number of rows, from the directory."""
        return self.directory().agg(F.max("upto")).first()[0] or 0

    def slice(self, start: int, stop: int) -> DataFrame:
        """Rows at positions ``start`` to ``stop`` (both included, negative ones from the end), with ``pos`` from 0.

        The directory's rows of the parts hit come to the driver: as many as parts hold the range.
        """
        if start < 0 or stop < 0:
            n = self.size()
            start, stop = (max(0, i + n) if i < 0 else i for i in (start, stop)) if stop >= -n else (1, 0)
        hit = self.directory().where((F.col("upto") > start) & (F.col("upto") - F.col("rows") <= stop)).collect()
        rows = self._rows().where(F.col("_part").isin([r["_part"] for r in hit]))
        before = F.coalesce(*[F.when(F.col("_part") == r["_part"], F.lit(r["upto"] - r["rows"])) for r in hit]) if hit else F.lit(0)
        keys = [F.desc(c) if down else F.asc(c) for c, down in self.order]
        inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
        numbered = rows.withColumn("pos", (before + inside).cast("bigint"))
        return numbered.where(F.col("pos").between(start, stop)).drop("_part")

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1) with ``total`` and ``page``."""
        found = self.slice((number - 1) * size, number * size - 1)
        return found.withColumns({"total": F.lit(self.size()).cast("bigint"), "page": F.lit(number)})


# --- pages ------------------------------------------------------------------------------------

def page(df: DataFrame, skip: int, limit: int, newest: str, row_id: str, category: Column | None = None) -> DataFrame:
    """Newest first with the total and the page number; early pages sort as a top-k."""
    chosen = df if category is None else df.where(category)
    total = chosen.agg(F.count(F.lit(1))).scalar()
    return (chosen.orderBy(F.desc(newest), row_id).offset(skip).limit(limit)
            .withColumn("total", total).withColumn("page", F.lit(skip // limit + 1)))


def page_after(df: DataFrame, key: str, last: object | None, n: int, filter_after: Column | None = None) -> DataFrame:
    """Keyset page with the next page's token (null at the end).

    ``filter_after`` is applied after the limit, as a scan with a filter does: such a
    page can be short or empty while its token still leads on.
    """
    rest = df if last is None else df.where(F.col(key) > last)
    head = rest.orderBy(key).limit(n + 1).withColumn("_rn", F.row_number().over(Window.orderBy(key)))
    whole = Window.partitionBy()
    more = F.max("_rn").over(whole) > n
    token = F.when(more, F.max(F.when(F.col("_rn") <= n, F.col(key))).over(whole)).cast("string")
    shown = head.withColumn("next_token", token).where(F.col("_rn") <= n).drop("_rn")
    return shown if filter_after is None else shown.where(filter_after)


def stream_id(c: str | Column) -> tuple[Column, Column]:
    """``ms-seq`` id as two numbers, so that ids sort by value and not by text."""
    return (F.substring_index(column(c), "-", 1).cast("bigint"), F.substring_index(column(c), "-", -1).cast("bigint"))


def tail(df: DataFrame, entry_id: str, n: int) -> DataFrame:
    ms, seq = stream_id(entry_id)
    return df.orderBy(ms.desc(), seq.desc()).limit(n)


def head(df: DataFrame, entry_id: str, n: int) -> DataFrame:
    ms, seq = stream_id(entry_id)
    return df.orderBy(ms.asc(), seq.asc()).limit(n)


def slowest(df: DataFrame, n: int, rt: str = "rt", tie: str = "event_id") -> DataFrame:
    return df.orderBy(F.desc(rt), tie).limit(n)


def latest_for(df: DataFrame, key: str, value: object, newest: str, tie: str, n: int = 50) -> DataFrame:
    return df.where(F.col(key) == value).orderBy(F.desc(newest), F.desc(tie)).limit(n)


def drain(queue: DataFrame, n: int, priority: str, arrival: Sequence[str]) -> DataFrame:
    """Next ``n`` of a priority queue: lowest priority number first, then first in."""
    return queue.orderBy(priority, *arrival).limit(n)
