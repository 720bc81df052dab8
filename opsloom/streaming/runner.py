"""Running streams: file sinks with checkpoints, idempotent batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.session import work_path


def file_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Stream over existing files, with the schema of the batch reader.

    The source takes a directory or a glob; a one-letter class makes the path of a single
    file a glob that matches just this path.
    """
    glob = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(spark.read.format(fmt).load(path).schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(glob)


def run_to_files(stream: DataFrame, label: str, spark: SparkSession) -> DataFrame:
    """Run an append stream until its input is used up, and read the result.

    The file sink's log makes each micro-batch appear exactly once, also after a restart.
    """
    out, state = work_path(spark, label), work_path(spark, label + "-checkpoint")
    q = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", state).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_to_batches(stream: DataFrame, label: str, spark: SparkSession, mode: str, sink: Callable[[DataFrame, int], None]) -> None:
    state = work_path(spark, label + "-checkpoint")
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(sink).start().awaitTermination()


def run_updates(stream: DataFrame, label: str, spark: SparkSession, keys: list[str]) -> DataFrame:
    """Final table of an aggregation in update mode.

    Each micro-batch writes the rows that changed, in a folder of its own, so a repeated batch replaces itself; reading
    takes the latest of each key. State ends with the watermark, where the stream has one.
    """
    from opsloom.operators.ranking import latest_by

    out = work_path(spark, label)
    run_to_batches(stream, label, spark, "update", lambda df, batch: df.withColumn("_batch", F.lit(batch).cast("bigint"))
                   .write.mode("overwrite").parquet(f"{out}/v{batch}"))
    return latest_by(spark.read.parquet(f"{out}/v*"), keys, ["_batch"]).drop("_batch")


def write_idempotent(path: str) -> Callable[[DataFrame, int], None]:
    """Sink whose output folder is named by the batch: a repeated batch replaces itself."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def upsert_latest(path: str, key: str, version: str, spark: SparkSession) -> Callable[[DataFrame, int], None]:
    """Sink for the newest row per key; applying a batch twice changes nothing.

    Each batch writes its own newest rows only; readers compact the folders ``v*`` with ``latest_by``.
    """
    from opsloom.operators.ranking import latest_by

    def sink(df: DataFrame, batch: int) -> None:
        latest_by(df, [key], [version]).select(*df.columns).write.mode("overwrite").parquet(f"{path}/v{batch}")

    return sink


def fan_out_sinks(path: str, column: str) -> Callable[[DataFrame, int], None]:
    """One write per micro-batch, with a folder per subscription in it."""
    return lambda df, batch: df.write.mode("overwrite").partitionBy(column).parquet(f"{path}/batch={batch}")


def deliver(stream: DataFrame, path: str, checkpoint: str, every: str) -> Any:
    """Buffered delivery: one write per interval; size bounds sit on the source (``maxFilesPerTrigger``)."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime=every).start(path)
