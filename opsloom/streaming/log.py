"""Event log reads, group consumption, lag and replay (J10-J16) and delivery."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.patterns import column_fields, policy
from opsloom.functions.timeutil import micros, ntz
from opsloom.operators.limits import rate_anchored
from opsloom.operators.ranking import stream_id


def _id_struct(entry: Column | str) -> Column:
    ms, seq = stream_id(entry)
    return F.struct(ms.alias("ms"), seq.alias("seq"))


def range_read(df: DataFrame, entry_id: str, start: str = "-", end: str = "+", n: int | None = None) -> DataFrame:
    """Entries between two ids (both included); ``-`` and ``+`` are the open ends."""
    here = _id_struct(entry_id)
    if start != "-":
        df = df.where(here >= _id_struct(F.lit(start)))
    if end != "+":
        df = df.where(here <= _id_struct(F.lit(end)))
    if n is None:
        return df
    ms, seq = stream_id(entry_id)
    return df.orderBy(ms, seq).limit(n)


def since(df: DataFrame, entry_id: str, last: str) -> DataFrame:
    """Entries after ``last``; a checkpointed stream does the same by itself."""
    return df.where(_id_struct(entry_id) > _id_struct(F.lit(last)))


def stream_info(df: DataFrame, entry_id: str) -> DataFrame:
    here = _id_struct(entry_id)
    return df.agg(F.count(F.lit(1)).alias("length"), F.min_by(entry_id, here).alias("first_id"), F.max_by(entry_id, here).alias("last_id"))


def pending(deliveries: DataFrame, acks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delivered but not acknowledged entries of each group."""
    return deliveries.join(acks.select(*keys), list(keys), "left_anti")


def claimable(pending_rows: DataFrame, delivered: str, now: str, idle_seconds: float) -> DataFrame:
    """Pending entries idle long enough to be taken over."""
    return pending_rows.where(micros(ntz(now)) - micros(delivered) > int(idle_seconds * 1_000_000))


def lag(ends: DataFrame, committed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest minus committed offset per partition; nothing committed means the full backlog."""
    joined = ends.join(committed, list(keys), "left")
    return joined.withColumn("lag", F.col("latest") - F.coalesce("committed", F.lit(0))).select(*keys, "lag")


def total_lag(lags: DataFrame, group: str) -> DataFrame:
    return lags.groupBy(group).agg(F.sum("lag").alias("lag"))


def replay_from(log: DataFrame, spec: Mapping[str, object], partition: str, offset: str, ts: str, committed: DataFrame | None = None) -> DataFrame:
    """Rows to read again: ``earliest``, ``offset``, ``shift`` (from the committed offset) or ``datetime``.

    A shift is clamped to the partition's valid offsets.
    """
    (kind, value), = spec.items()
    if kind == "earliest":
        return log
    if kind == "offset":
        return log.where(F.col(offset) >= value)
    if kind == "datetime":
        return log.where(F.col(ts) >= ntz(value))
    if kind == "shift":
        bounds = log.groupBy(partition).agg(F.min(offset).alias("_lo"), F.max(offset).alias("_hi"))
        target = F.least(F.greatest(F.col("committed") + F.lit(value), F.col("_lo")), F.col("_hi") + 1)
        starts = bounds.join(committed, partition).select(partition, target.alias("_from"))
        return log.join(starts, partition).where(F.col(offset) >= F.col("_from")).drop("_from")
    raise ValueError(f"unknown replay start {kind}")


def split_bad(df: DataFrame, body: str, schema: str, required: Sequence[str]) -> DataFrame:
    """Decoded rows with an ``error`` text: empty for good rows, else why the row goes to the dead-letter sink."""
    doc = F.from_json(F.col(body), schema + ", _corrupt_record string", {"mode": "PERMISSIVE"})
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_doc.{n}").isNull(), n) for n in required])), ",")
    error = F.when(F.col("_doc").isNull() | F.col("_doc._corrupt_record").isNotNull(), "undecodable").when(
        missing != "", F.concat(F.lit("missing "), missing)).otherwise("")
    return df.withColumn("_doc", doc).withColumn("error", error)


def good_and_bad(df: DataFrame, body: str, schema: str, required: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    judged = split_bad(df, body, schema, required)
    good = judged.where(F.col("error") == "").select(*keep, "_doc.*").drop("_corrupt_record")
    return good, judged.where(F.col("error") != "").select(*keep, body, "error")


def redrive(attempts: DataFrame, message: str, failed: Column, max_receives: int = 5) -> tuple[DataFrame, DataFrame]:
    """Messages that failed ``max_receives`` times or more (dead letters), and those to retry."""
    fails = attempts.groupBy(message).agg(F.count_if(failed).alias("fails"), F.count_if(~failed).alias("_done"))
    dead = fails.where((F.col("fails") >= max_receives) & (F.col("_done") == 0)).drop("_done")
    retry = fails.where((F.col("fails") > 0) & (F.col("fails") < max_receives) & (F.col("_done") == 0)).drop("_done")
    return dead, retry


def content_id(body: Column) -> Column:
    return F.sha2(body, 256)


def dedup(df: DataFrame, key: str, ts: str, row_id: str, seconds: int) -> DataFrame:
    """Drop a message whose id was accepted within the interval before it.

    The first message opens the interval; repeats inside it are ignored and do not extend it.
    A stream uses ``dropDuplicatesWithinWatermark``.
    """
    if df.isStreaming:
        return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark([key])
    kept = rate_anchored(df, key, ts, row_id, 1, seconds).where("allowed").select(row_id)
    return df.join(kept, row_id, "left_semi")


def route_events(df: DataFrame, kind: str, known: Sequence[str]) -> DataFrame:
    """``route``: the event type when known, else ``unknown``."""
    return df.withColumn("route", F.when(F.col(kind).isin(list(known)), F.col(kind)).otherwise("unknown"))


def fan_out(df: DataFrame, routes: Mapping[str, Mapping]) -> DataFrame:
    """One row per (input row, matching subscription); a row no policy accepts disappears."""
    fields = column_fields(df)
    names = F.array_compact(F.array(*[F.when(policy(spec, fields), name) for name, spec in routes.items()]))
    return df.withColumn("subscription", F.explode(names))


def echo(df: DataFrame, name: str, message: str) -> DataFrame:
    return df.withColumn("reply", F.concat_ws(": ", name, message))


def collect_requests(df: DataFrame, client: str, closing: str = "%d requests received") -> DataFrame:
    """Number of requests per client stream and a closing message about it; the requests stay rows."""
    counted = df.groupBy(client).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("reply", F.format_string(closing, F.col("n")))


def pipe(df: DataFrame, spec: Mapping, dim: DataFrame, key: str) -> DataFrame:
    """Filter by pattern, then enrich."""
    return df.where(policy(spec, column_fields(df))).join(dim, key, "left")


def replay_archive(df: DataFrame, ts: str, start: str, end: str, spec: Mapping) -> DataFrame:
    """Archived events of a time range that match a pattern."""
    inside = df.where((F.col(ts) >= ntz(start)) & (F.col(ts) <= ntz(end)))
    return inside.where(policy(spec, column_fields(df)))
