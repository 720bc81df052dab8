"""Sinks and table layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions.hashing import key_partition
from opsloom.functions.timeutil import ntz


def write_columnar(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = (), codec: str = "snappy",
                   mode: str = "overwrite") -> None:
    """Parquet or ORC (or compressed JSON/CSV text), partitioned by ``by``.

    Rows are not regrouped before a partitioned write: a hot partition value keeps many writers.
    """
    writer = df.write.format(fmt).mode(mode).option("compression", codec)
    (writer.partitionBy(*by) if by else writer).save(path)


def export(df: DataFrame, path: str, changed: str, since: str | None = None, until: str | None = None) -> None:
    """Full export, or the rows changed in ``[since, until)``."""
    chosen = df
    if since is not None:
        chosen = chosen.where(F.col(changed) >= ntz(since))
    if until is not None:
        chosen = chosen.where(F.col(changed) < ntz(until))
    chosen.write.mode("overwrite").parquet(path)


def partition_value(kind: str, col: str, groups: dict[str, Sequence[object]] | None = None, n: int = 4) -> Column:
    """Layout column: ``range`` (calendar quarter), ``list`` (named groups, else default) or ``hash`` (mod n)."""
    if kind == "range":
        return F.concat(F.year(col).cast("string"), F.lit("q"), F.quarter(col).cast("string"))
    if kind == "list":
        value = F.lit("default")
        for name, members in (groups or {}).items():
            value = F.when(F.col(col).isin(list(members)), name).otherwise(value)
        return value
    if kind == "hash":
        return key_partition(col, n)
    raise ValueError(f"unknown layout {kind}")


def write_partitioned(df: DataFrame, path: str, kind: str, col: str, name: str = "part", **layout: object) -> None:
    df.withColumn(name, partition_value(kind, col, **layout)).write.mode("overwrite").partitionBy(name).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """Table hashed and sorted by ``key``: two tables with equal buckets join on it without a shuffle.

    Rows are grouped by bucket before the write, so each bucket becomes one file and not one per task.
    """
    grouped = df.repartition(buckets, key)
    grouped.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def drop_partitions(spark: SparkSession, table: str, column: str, before: str) -> list[str]:
    """Drop whole partitions below ``before``; only catalog metadata is read."""
    names = [row[0].split("=", 1)[1] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    old = sorted(n for n in names if n < before)
    if old:
        specs = ", ".join(f"PARTITION ({column} = '{n}')" for n in old)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    return old


def load(df: DataFrame, path: str) -> None:
    """Append a batch of rows to a table directory."""
    df.write.mode("append").parquet(path)
