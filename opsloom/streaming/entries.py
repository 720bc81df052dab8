"""Appended entries with generated, ordered ids (J10, J11): a stored high-water mark per stream of entries.

An id is ``ms-seq``. An entry takes its own time, or the stream's last time when the clock stood still or went back, and the
next number within that time; so ids of a stream only grow, whatever the times of the entries. Every batch writes two folders
named by its number, its entries and its marks. A repeated batch reads the marks before it and replaces its own folders, so
nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions.ordered import position, slots
from opsloom.streaming.log import range_read

EFFECTIVE = "_ms"


class EntryLog:
    """Entries of many streams under one path; batches are numbered 0, 1, 2 ... (as ``foreachBatch`` does).

    ``key`` names a stream (null is one, too), ``ms`` is a column of milliseconds (null: the stream's last time, or 0) and
    ``tie`` orders entries of one batch and time. ``chunk_ms`` bounds the entries of a stream that one task orders.
    Marks of changed streams are written per batch and all of them every ``FULL`` batches, so at most ``FULL`` folders are read.
    """

    FULL = 16

    def __init__(self, spark: SparkSession, path: str, key: str, ms: str, tie: str, chunk_ms: int = 3_600_000, fan: int = 1000) -> None:
        self.spark, self.path, self.key, self.ms, self.tie = spark, path.rstrip("/"), key, ms, tie
        self.chunk_ms, self.fan = chunk_ms, fan

    def _marks(self, batch: int, kind: str) -> DataFrame:
        """The last id of every stream before ``batch``."""
        schema = f"`{self.key}` {kind}, ms bigint, seq bigint, batch bigint"
        empty = self.spark.createDataFrame([], schema)
        if batch == 0:
            return empty.drop("batch")
        first = (batch - 1) // self.FULL * self.FULL
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/marks").parquet(
            *[f"{self.path}/marks/batch={n}" for n in range(first, batch)])
        return (rows.groupBy(self.key).agg(F.max_by(F.struct("ms", "seq"), "batch").alias("_mark")).select(self.key, "_mark.*"))

    def append(self, rows: DataFrame, batch: int) -> None:
        """Give ``rows`` their ids and store them as batch number ``batch``; all batches before it are stored."""
        kind = rows.schema[self.key].dataType.simpleString()
        marks = self._marks(batch, kind)
        place = F.struct(F.col(self.key)).alias("_stream")
        known = marks.select(place, F.col("ms").alias("_last_ms"), F.col("seq").alias("_last_seq"))
        joined = rows.withColumn("_stream", place).join(known, "_stream", "left")
        timed = joined.withColumn(EFFECTIVE, F.greatest(F.col(self.ms).cast("bigint"), F.coalesce("_last_ms", F.lit(0))))
        numbered = position(timed, [self.key, EFFECTIVE], [self.ms, self.tie], slots(self.ms, self.chunk_ms), "_seq")
        after = F.when(F.col(EFFECTIVE) == F.col("_last_ms"), F.col("_last_seq") + 1).otherwise(0)
        entries = numbered.withColumn("_seq", F.col("_seq") + after).select(*rows.columns, EFFECTIVE, "_seq")
        target = f"{self.path}/entries/batch={batch}"
        entries.write.mode("overwrite").parquet(target)
        stored = self.spark.read.schema(entries.schema).parquet(target)
        tops = stored.groupBy(self.key).agg(F.max(F.struct(F.col(EFFECTIVE).alias("ms"), F.col("_seq").alias("seq"))).alias("_top")).select(self.key, "_top.*")
        if batch % self.FULL == 0:
            tops = tops.unionByName(marks).groupBy(self.key).agg(F.max(F.struct("ms", "seq")).alias("_top")).select(self.key, "_top.*")
        tops.write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch}")

    def read(self) -> DataFrame:
        """All entries with ``entry_id``; ``_ms`` and ``_seq`` are its parts, plain columns that scans can filter."""
        rows = self.spark.read.option("basePath", f"{self.path}/entries").parquet(f"{self.path}/entries/batch=*").drop("batch")
        return rows.withColumn("entry_id", F.concat_ws("-", F.col(EFFECTIVE).cast("string"), F.col("_seq").cast("string")))

    def between(self, stream: object, start: str = "-", end: str = "+", n: int | None = None) -> DataFrame:
        """Entries of one stream from id ``start`` to ``end``, the first ``n``; the times bound the scan, ids are unique."""
        rows = self.read().where(F.col(self.key).eqNullSafe(F.lit(stream)))
        if start != "-":
            rows = rows.where(F.col(EFFECTIVE) >= int(start.split("-")[0]))
        if end != "+":
            rows = rows.where(F.col(EFFECTIVE) <= int(end.split("-")[0]))
        return range_read(rows, "entry_id", start, end, n)
