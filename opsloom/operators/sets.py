"""Set algebra over member rows (G1-G7). A set is a one-column DataFrame; keyed sets are (key, member) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sunion(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def sinter(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, sets)


def sdiff(first: DataFrame, *rest: DataFrame) -> DataFrame:
    return reduce(DataFrame.subtract, rest, first)


def store(result: DataFrame, path: str) -> DataFrame:
    """Write a result set and read it back (the ``...STORE`` forms)."""
    result.write.mode("overwrite").parquet(path)
    return result.sparkSession.read.schema(result.schema).parquet(path)


def set_from_events(events: DataFrame, key: str, member: str, op: str, order: list[str]) -> DataFrame:
    """Members after all add/remove events: the last event per member decides."""
    last = events.groupBy(key, member).agg(F.max_by(op, F.struct(*order)).alias("_op"))
    return last.where(F.col("_op") == "add").drop("_op")


def smove(members: DataFrame, key: str, member: str, source: str, target: str, value: object) -> DataFrame:
    """Move one member; nothing happens unless the source holds it."""
    moving = (F.col(key) == source) & (F.col(member) == value)
    return members.withColumn(key, F.when(moving, F.lit(target)).otherwise(F.col(key))).distinct()


def scard(members: DataFrame, key: str, member: str) -> DataFrame:
    return members.groupBy(key).agg(F.count_distinct(member).alias("n"))


def sismember(members: DataFrame, key: str, member: str, name: str, value: object) -> DataFrame:
    hit = (F.col(key) == name) & (F.col(member) == value)
    return members.where(hit).agg((F.count(F.lit(1)) > 0).alias("is_member"))


def smembers(members: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """Members of one set as rows; a hot set is never packed into one array."""
    return members.where(F.col(key) == name).select(member).distinct()


def common(members: DataFrame, key: str, member: str, a: str, b: str) -> DataFrame:
    """Members two keys share, by counting keys per member."""
    both = members.where(F.col(key).isin(a, b)).groupBy(member).agg(F.count_distinct(key).alias("_keys"))
    return both.where(F.col("_keys") == 2).select(member)
