"""Windows over event time (J1-J9, J27-J29). Every function takes a static or a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.ordered import CHUNK, first_n
from opsloom.functions.patterns import label_selector, metric_pattern
from opsloom.functions.timeutil import micros, ntz, time_chunk
from opsloom.operators.aggregates import n_rows


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event-time column with a watermark: rows later than ``delay`` are dropped (the delay is ours).

    Watermarks need TIMESTAMP, so a TIMESTAMP_NTZ column is cast; keep the session on UTC.
    """
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_filter(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def alerts(df: DataFrame, value: str, threshold: float) -> DataFrame:
    return df.where(F.col(value) > threshold)


def _slot(df: DataFrame) -> list[Column]:
    return [F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end")]


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str] = (), aggs: Sequence[Column] | None = None) -> DataFrame:
    aggs = list(aggs) if aggs else [n_rows("n")]
    out = df.groupBy(F.window(ts, size), *keys).agg(*aggs)
    return out.select(*_slot(out), *keys, *out.columns[1 + len(keys):])


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str] = (), aggs: Sequence[Column] | None = None) -> DataFrame:
    aggs = list(aggs) if aggs else [n_rows("n")]
    out = df.groupBy(F.window(ts, size, slide), *keys).agg(*aggs)
    return out.select(*_slot(out), *keys, *out.columns[1 + len(keys):])


def sessions(df: DataFrame, key: str, ts: str, row_id: str, gap_seconds: int, chunk_seconds: float = 86400) -> DataFrame:
    """Sessions closed by ``gap_seconds`` of silence: start, end of the gap and row count.

    A stream uses ``session_window``. The batch form cuts at gaps found chunk by chunk, so a
    key without pauses is not sorted in one task. Null keys are one key; rows without a time are left out.
    """
    if df.isStreaming:
        out = df.groupBy(F.session_window(ts, f"{gap_seconds} seconds").alias("window"), key).agg(n_rows("n"))
        return out.select(*_slot(out), key, "n")
    chunk = time_chunk(ts, chunk_seconds)
    inside = Window.partitionBy(key, CHUNK).orderBy(ts, row_id)
    silent = lambda since, until: F.when(
        since.isNull() | (micros(until) - micros(since) >= gap_seconds * 1_000_000), 1).otherwise(0)
    # The rows are shuffled once, on (key, chunk); what follows works on sessions and chunks.
    opened = df.where(F.col(ts).isNotNull()).select(key, ts, row_id).withColumn(CHUNK, chunk).withColumn("_opens", silent(F.lag(ts).over(inside), F.col(ts)))
    numbered = opened.withColumn("_no", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = numbered.groupBy(key, CHUNK, "_no").agg(F.min(ts).alias("start"), F.max(ts).alias("_last"), n_rows("n"))
    # One row per chunk: does its first session continue the chunk before, and how many came earlier?
    by_chunk = Window.partitionBy(key).orderBy(CHUNK)
    chunks = local.groupBy(key, CHUNK).agg(F.min("start").alias("_first"), F.max("_last").alias("_end"), F.max("_no").alias("_count"))
    chunks = chunks.withColumn("_joins", 1 - silent(F.lag("_end").over(by_chunk), F.col("_first")))
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_before", F.coalesce(F.sum(F.col("_count") - F.col("_joins")).over(earlier), F.lit(0)))
    place = F.struct(key, CHUNK).alias("_place")  # joins null keys too
    spans = (local.select("*", place).join(chunks.select(place, "_joins", "_before"), "_place")
             .groupBy(key, (F.col("_before") + F.col("_no") - F.col("_joins")).alias("_session"))
             .agg(F.min("start").alias("start"), F.max("_last").alias("_last"), F.sum("n").alias("n")))
    return spans.select("start", F.timestamp_add("SECOND", F.lit(gap_seconds), F.col("_last")).alias("end"), key, "n")


def sensor_average(df: DataFrame, ts: str, sensor: str, value: str, size: str) -> DataFrame:
    """Average per sensor and window, exact for decimals."""
    mean = F.sum(value).cast("double") / F.count(value)
    return tumbling(df, ts, size, [sensor], [mean.alias("average"), F.count(value).alias("samples")])


def popular_pages(df: DataFrame, ts: str, page: str, size: str, n: int) -> DataFrame:
    """Top ``n`` pages per window; on a stream rank inside ``foreachBatch``."""
    counted = tumbling(df, ts, size, [page], [n_rows("views")])
    if df.isStreaming:
        return counted
    return first_n(counted, ["start"], [F.desc("views"), F.asc(page)], n, F.col(page), out="rank")


# Aggregations a downsampling rule may name.
AGGREGATIONS = {"avg": lambda c: F.sum(c).cast("double") / F.count(c), "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def downsample(df: DataFrame, ts: str, value: str, size: str, agg: str = "avg", keys: Sequence[str] = ()) -> DataFrame:
    return tumbling(df, ts, size, keys, [AGGREGATIONS[agg](value).alias("value")])


def ts_range(df: DataFrame, ts: str, start: str, end: str, selector: str | None = None, labels: str = "labels") -> DataFrame:
    """Samples of a closed time range, optionally of the series a label selector picks."""
    picked = df.where((F.col(ts) >= ntz(start)) & (F.col(ts) <= ntz(end)))
    return picked if selector is None else picked.where(label_selector(selector, F.col(labels)))


def log_metric(df: DataFrame, ts: str, message: str, pattern: str, size: str) -> DataFrame:
    """Matching log lines per period."""
    return tumbling(df.where(metric_pattern(pattern, F.col(message))), ts, size)


def cart_stream(df: DataFrame, keys: Sequence[str], quantity: str) -> DataFrame:
    """Current cart per customer as running state: additions and removals per line."""
    return df.groupBy(*keys).agg(F.sum(quantity).alias("quantity"))


def transform(df: DataFrame, clean: Mapping[str, Column], required: Sequence[str], dim: DataFrame | None = None,
              key: str | None = None) -> DataFrame:
    """In-flight transformation: validate, clean or mask, enrich."""
    for name in required:
        df = df.where(F.col(name).isNotNull())
    df = df.withColumns(dict(clean))
    return df if dim is None else df.join(dim, key, "left")


def evolve(df: DataFrame, known: Mapping[str, Column]) -> DataFrame:
    """Reader schema: a missing new column gets its default, unknown extras are ignored."""
    present = set(df.columns)
    return df.select(*[(F.coalesce(F.col(n), default) if n in present else default).alias(n) for n, default in known.items()])
