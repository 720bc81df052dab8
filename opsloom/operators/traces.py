"""Traces, service maps, audit logs and integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.ordered import previous, running_sum
from opsloom.functions.timeutil import column, floor_time, micros, time_chunk
from opsloom.operators.aggregates import n_rows
from opsloom.operators.metrics import trailing_baseline

# The common fields of an audit record.
AUDIT_RECORDS = """Records array<struct<eventVersion: string, eventTime: string, eventSource: string, eventName: string,
awsRegion: string, sourceIPAddress: string, userIdentity: struct<type: string, userName: string>>>"""

# Status classes: 429 is a throttle, other 4xx an error, 5xx a fault (the codes are our choice).


def error_class(status: str | Column) -> Column:
    s = column(status)
    return F.when(s == 429, "throttle").when(s.between(400, 499), "error").when(s.between(500, 599), "fault").otherwise("ok")


def classify_errors(segments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    kind = error_class("status")
    return segments.groupBy(*keys).agg(n_rows("calls"), *[F.count_if(kind == k).alias(k) for k in ("error", "fault", "throttle")])


def traces(segments: DataFrame) -> DataFrame:
    """Per trace: segment count and latency from first start to last end."""
    return segments.groupBy("trace_id").agg(n_rows("segments"), (F.max("end_ms") - F.min("start_ms")).alias("latency_ms"),
                                            (F.max(F.when(error_class("status") != "ok", 1).otherwise(0)) == 1).alias("has_error"))


def timeline(segments: DataFrame) -> DataFrame:
    """Time spent per service of a trace."""
    return segments.groupBy("trace_id", "service").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("busy_ms"))


def bottleneck(segments: DataFrame) -> DataFrame:
    """Slowest service of each trace; equal times go to the greater name."""
    return timeline(segments).groupBy("trace_id").agg(
        F.max_by("service", F.struct("busy_ms", "service")).alias("service"), F.max("busy_ms").alias("busy_ms"))


def find_traces(segments: DataFrame, wanted: Column, min_latency_ms: int = 0) -> DataFrame:
    """Traces with a segment that fits ``wanted`` and at least the given latency."""
    whole = traces(segments).where(F.col("latency_ms") >= min_latency_ms)
    return whole.join(segments.where(wanted).select("trace_id"), "trace_id", "left_semi")


def service_map(segments: DataFrame) -> DataFrame:
    """Caller to callee edges with call count, mean latency and error, fault and throttle rates."""
    callers = segments.select("trace_id", F.col("segment_id").alias("parent_id"), F.col("service").alias("caller"))
    calls = segments.join(callers, ["trace_id", "parent_id"])
    kind = error_class("status")
    total = F.count(F.lit(1))
    return calls.groupBy("caller", F.col("service").alias("callee")).agg(
        n_rows("calls"), (F.sum(F.col("end_ms") - F.col("start_ms")) / total).alias("mean_ms"),
        *[(F.count_if(kind == k) / total).alias(f"{k}_rate") for k in ("error", "fault", "throttle")])


def service_stats(segments: DataFrame, seconds: float, ts: str = "ts") -> DataFrame:
    slotted = segments.withColumn("slot", floor_time(ts, seconds))
    return classify_errors(slotted, ["slot", "service"])


def audit_events(df: DataFrame, body: str) -> DataFrame:
    """One row per entry of a ``Records[]`` audit file, with the common fields."""
    doc = F.from_json(F.col(body), AUDIT_RECORDS)
    entry = df.select(F.explode(doc["Records"]).alias("r"))
    return entry.select("r.*").withColumn("eventTime", F.try_to_timestamp("eventTime"))


def api_anomalies(events: DataFrame, api: str, ts: str, seconds: int, periods: int, k: float, bad: Column | None = None) -> DataFrame:
    """Stretches of periods whose call (or error) count exceeds baseline + k deviations (k is ours).

    One row per stretch: start, end, mean baseline, peak count and length in periods.
    """
    chosen = events if bad is None else events.where(bad)
    counts = chosen.groupBy(floor_time(ts, seconds).alias("period"), api).agg(n_rows("n"))
    judged = trailing_baseline(counts, [api], "period", "n", periods, seconds)
    hot = judged.where(F.col("n") > F.col("baseline") + F.col("deviation") * k)
    chunk = time_chunk("period", 86400 * 30)
    lagged = previous(hot, [api], ["period"], chunk, {"_prev": F.col("period")})
    opens = F.when(F.col("_prev").isNull() | (micros("period") - micros("_prev") > seconds * 1_000_000), 1).otherwise(0)
    grouped = running_sum(lagged, [api], ["period"], chunk, {"_run": opens}).groupBy(api, "_run").agg(
        F.min("period").alias("start"), F.max("period").alias("last"), n_rows("periods"), F.max("n").alias("peak"),
        F.min_by("baseline", "period").alias("baseline"))
    return grouped.select(api, "start", F.timestamp_add("SECOND", F.lit(seconds), F.col("last")).alias("end"), "baseline", "peak", "periods")


def verify_digests(files: DataFrame, digests: DataFrame, key: str) -> DataFrame:
    """``match``, ``mismatch``, ``missing file`` or ``no digest`` per entry; inputs are (key, digest)."""
    both = files.select(key, F.col("digest").alias("_found")).join(digests.select(key, F.col("digest").alias("_listed")), key, "full_outer")
    state = F.when(F.col("_found").isNull(), "missing file").when(F.col("_listed").isNull(), "no digest").when(
        F.col("_found") == F.col("_listed"), "match").otherwise("mismatch")
    return both.select(key, state.alias("state"))
