"""Rate limits and quotas (E20-E26) and sized stock requests.

Counting limiters are joins and windows. The limiters that do not store rejected requests
are folds: each decision depends on the one before. They are cut where the limiter's state is
known to be fresh, and the pieces run in parallel.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.ordered import CHUNK, PLACE, placed, slots, trailing_count
from opsloom.functions.timeutil import floor_time, from_micros, micros
from opsloom.operators.aggregates import n_rows

# (times in us, amounts, state or None) -> (allowed flags, state)
Fold = Callable[[np.ndarray, np.ndarray, "list[int] | None"], "tuple[np.ndarray, list[int]]"]
# (times in us, amounts) of a segment with a fresh limiter -> whether nothing in it can be denied
Harmless = Callable[[np.ndarray, np.ndarray], bool]


def rate_fixed(df: DataFrame, key: str, ts: str, row_id: str, limit: int | Column, seconds: float, salts: int = 64) -> DataFrame:
    """Clock-aligned window: the first ``limit`` requests of each window pass.

    A request that already has ``limit`` earlier ones in its own salt is denied there, so a
    hot window sends at most ``limit * salts`` rows on to the deciding pass.
    """
    cap = F.lit(limit) if isinstance(limit, int) else limit
    spread = df.withColumns({"_win": floor_time(ts, seconds), "_salt": F.pmod(F.xxhash64(row_id), F.lit(salts)), "_cap": cap})
    local = F.row_number().over(Window.partitionBy(key, "_win", "_salt").orderBy(ts, row_id))
    # Requests denied by their salt stay apart; the others of a window meet.
    ranked = spread.withColumn("_open", local <= F.col("_cap")).withColumn("_salt", F.when(F.col("_open"), -1).otherwise(F.col("_salt")))
    rank = F.row_number().over(Window.partitionBy(key, "_win", "_salt").orderBy(ts, row_id))
    return ranked.withColumn("allowed", F.col("_open") & (rank <= F.col("_cap"))).drop("_win", "_salt", "_cap", "_open")


def quota(df: DataFrame, limits: DataFrame, key: str, ts: str, row_id: str, seconds: float) -> DataFrame:
    """Fixed window with a limit per tenant; ``limits(key, quota)``. Unknown tenants get 0."""
    known = df.join(limits, key, "left").fillna(0, ["quota"])
    return rate_fixed(known, key, ts, row_id, F.col("quota"), seconds).drop("quota")


def rate_sliding_flag(df: DataFrame, key: str, ts: str, limit: int, seconds: float, chunk_seconds: float = 3600) -> DataFrame:
    """Requests in the trailing window (this one included) and whether they exceed the limit."""
    counted = trailing_count(df.withColumn("_us", micros(ts)), [key], "_us", int(seconds * 1_000_000),
                             int(chunk_seconds * 1_000_000), "in_window")
    return counted.withColumn("over", F.col("in_window") > limit).drop("_us")


def rate_buckets(df: DataFrame, key: str, ts: str, limit: int, seconds: float, buckets: int = 10) -> DataFrame:
    """Sliding counter from sub-windows: requests of the last ``buckets`` sub-windows, per sub-window."""
    width = int(seconds * 1_000_000 / buckets)
    counted = df.groupBy(key, F.floor(micros(ts) / F.lit(width)).alias("_b")).agg(n_rows("requests"))
    last = Window.partitionBy(key).orderBy("_b").rangeBetween(-(buckets - 1), 0)
    summed = counted.withColumn("in_window", F.sum("requests").over(last))
    return summed.select(key, from_micros(F.col("_b") * width).alias("slot"), "requests", "in_window",
                         (F.col("in_window") > limit).alias("over"))


# --- folds ------------------------------------------------------------------------------------

def anchored_fold(limit: int, window_us: int) -> Fold:
    """State: start of the open window, requests counted in it."""
    def fold(times, amounts, state):
        start, used = state or (None, 0)
        allowed = np.empty(len(times), dtype=bool)
        for i, now in enumerate(times.tolist()):
            if start is None or now >= start + window_us:
                start, used = now, 0
            used += 1
            allowed[i] = used <= limit
        return allowed, [start, min(used, limit)]
    return fold


def sliding_fold(limit: int, window_us: int) -> Fold:
    """State: times of the accepted requests still inside the window."""
    def fold(times, amounts, state):
        held = deque(state or [])
        allowed = np.empty(len(times), dtype=bool)
        for i, now in enumerate(times.tolist()):
            while held and held[0] <= now - window_us:
                held.popleft()
            allowed[i] = len(held) < limit
            if allowed[i]:
                held.append(now)
        return allowed, list(held)
    return fold


def token_fold(capacity: int, refill_us: int) -> Fold:
    """State: credit in microseconds of refill (one token costs ``refill_us``), last time."""
    full = capacity * refill_us

    def fold(times, amounts, state):
        credit, last = state or (full, None)
        allowed = np.empty(len(times), dtype=bool)
        for i, now in enumerate(times.tolist()):
            credit = full if last is None else min(full, credit + now - last)
            last = now
            allowed[i] = credit >= refill_us
            if allowed[i]:
                credit -= refill_us
        return allowed, [credit, last]
    return fold


def leaky_fold(burst: int, drain_us: int) -> Fold:
    """State: level in microseconds of drain, last time; rejected requests add nothing."""
    def fold(times, amounts, state):
        level, last = state or (0, None)
        allowed = np.empty(len(times), dtype=bool)
        for i, now in enumerate(times.tolist()):
            level = 0 if last is None else max(0, level - (now - last))
            last = now
            allowed[i] = level <= burst * drain_us
            if allowed[i]:
                level += drain_us
        return allowed, [level, last]
    return fold


def stock_fold(times, amounts, state):
    """State: remaining stock; the first amount of a key is its opening stock. A refused request takes nothing."""
    left = state[0] if state else None
    allowed = np.empty(len(amounts), dtype=bool)
    for i, (opening, wanted) in enumerate(amounts.tolist()):
        left = opening if left is None else left
        allowed[i] = wanted <= left
        if allowed[i]:
            left -= wanted
    return allowed, [left]


def _busy_periods(rows: DataFrame, key: str, us: str, row_id: str, cost_us: int, chunk_us: int) -> DataFrame:
    """``_seg``: the busy period of each request of a limiter that drains steadily (Lindley's recursion).

    If nothing were denied, the level before request ``i`` would be ``s(i) - min(s(j), j <= i)`` with ``s(i) = i * cost - time``:
    a request that finds level 0 begins a period, and the running minimum names it. Denials only lower levels, so the limiter
    is as good as new there. Chunks of a key are ordered apart; one row per chunk carries count and minimum on.
    """
    local = placed(rows, [key], slots(us, chunk_us))
    order = Window.partitionBy(PLACE).orderBy(us, row_id)
    local = local.withColumn("_s", F.row_number().over(order) * F.lit(cost_us) - F.col(us))
    local = local.withColumn("_low", F.min("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy(f"{PLACE}.{key}").orderBy(f"{PLACE}.{CHUNK}").rowsBetween(Window.unboundedPreceding, -1)
    carry = (local.groupBy(PLACE).agg(n_rows("_n"), F.min("_s").alias("_least"))
             .withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) * F.lit(cost_us))
             .withColumn("_before", F.min(F.col("_least") + F.col("_shift")).over(earlier)).select(PLACE, "_shift", "_before"))
    return local.join(carry, PLACE).withColumn("_seg", F.least(F.col("_low") + F.col("_shift"), F.col("_before"))).drop(
        CHUNK, PLACE, "_s", "_low", "_shift", "_before")


def _pauses(rows: DataFrame, key: str, us: str, row_id: str, reset_us: int, chunk_us: int) -> DataFrame:
    """``_seg``: time of the latest request that came ``reset_us`` or more after the one before it."""
    local = placed(rows, [key], slots(us, chunk_us))
    order = Window.partitionBy(PLACE).orderBy(us, row_id)
    opens = F.when(F.col(us) - F.lag(us).over(order) >= reset_us, F.col(us))
    local = local.withColumn("_open", opens)
    local = local.withColumn("_here", F.max("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = Window.partitionBy(f"{PLACE}.{key}").orderBy(f"{PLACE}.{CHUNK}")
    end = F.lag("_end").over(chunks)
    carry = (local.groupBy(PLACE).agg(F.min(us).alias("_first"), F.max(us).alias("_end"), F.max("_open").alias("_last"))
             .withColumn("_start", F.when(end.isNull() | (F.col("_first") - end >= reset_us), F.col("_first")))
             .withColumn("_last", F.coalesce("_last", "_start"))
             .withColumn("_before", F.last("_last", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)))
             .select(PLACE, F.coalesce("_start", "_before").alias("_head")))
    return local.join(carry, PLACE).withColumn("_seg", F.coalesce("_here", "_head")).drop(CHUNK, PLACE, "_open", "_here", "_head")


def fold_by_key(df: DataFrame, key: str, us: str, row_id: str, fold: Fold, reset_us: int | None = None, cost_us: int | None = None,
                amounts: list[str] | None = None, harmless: Harmless | None = None, chunk_us: int = 86_400_000_000) -> DataFrame:
    """``(key, us, row_id, allowed)`` from a per-key fold in time order.

    A key is cut into segments that each begin with a fresh limiter: busy periods, where the limiter drains steadily
    (``cost_us`` per request), else pauses of ``reset_us``. Segments are dealt to all tasks and stream through them, so
    memory doesn't depend on their length. A segment that is ``harmless`` (nothing in it can be denied) is allowed as a
    whole; only the others are decided request by request, which is sequential by definition.
    """
    amounts = amounts or []
    rows = df.select(key, us, row_id, *amounts)
    types = {c: df.schema[c].dataType.simpleString() for c in (key, row_id)}
    schema = f"{key} {types[key]}, {us} bigint, {row_id} {types[row_id]}, allowed boolean"
    if cost_us is not None:
        cut = _busy_periods(rows, key, us, row_id, cost_us, chunk_us)
    elif reset_us is not None:
        cut = _pauses(rows, key, us, row_id, reset_us, chunk_us)
    else:
        cut = rows.withColumn("_seg", F.lit(0).cast("bigint"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            flags = np.empty(len(pdf), dtype=bool)
            missing = pdf[key].isna()
            same = (pdf[key] == pdf[key].shift()) | (missing & missing.shift(fill_value=False))  # null keys are one key
            starts = np.flatnonzero(~same | (pdf["_seg"] != pdf["_seg"].shift()))
            times, sizes = pdf[us].to_numpy(), pdf[amounts].to_numpy()
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                here = (None if missing.iat[lo] else pdf[key].iat[lo], pdf["_seg"].iat[lo])
                # What goes on beyond the batch needs its state.
                if here != current and hi < len(pdf) and harmless is not None and harmless(times[lo:hi], sizes[lo:hi]):
                    flags[lo:hi], state = True, None
                else:
                    flags[lo:hi], state = fold(times[lo:hi], sizes[lo:hi], state if here == current else None)
                current = here
            yield pd.DataFrame({key: pdf[key], us: pdf[us], row_id: pdf[row_id], "allowed": flags})

    return cut.repartition(key, "_seg").sortWithinPartitions(key, "_seg", us, row_id).mapInPandas(run, schema)


def _within(limit: int, window_us: int) -> Harmless:
    """No more than ``limit`` requests in any window."""
    return lambda times, _: len(times) <= limit or bool((times[limit:] - times[:-limit] >= window_us).all())


def _below(cap_us: int, cost_us: int) -> Harmless:
    """The level never passes the cap, if all requests are allowed."""
    def check(times: np.ndarray, _: np.ndarray) -> bool:
        s = np.arange(1, len(times) + 1) * cost_us - times
        return bool((s - np.minimum.accumulate(s) + cost_us <= cap_us).all())
    return check


def _covered(_: np.ndarray, amounts: np.ndarray) -> bool:
    """The opening stock covers everything asked for."""
    return bool((amounts[:, 1] >= 0).all() and amounts[:, 1].sum() <= amounts[0, 0])


def _timed(df, key, ts, row_id):
    return df.select(key, micros(ts).alias("us"), row_id)


def rate_anchored(df: DataFrame, key: str, ts: str, row_id: str, limit: int, seconds: float, **tuning) -> DataFrame:
    """Window opened by the first request after the last one expired.

    Whether rejected requests are counted or not, the same requests are allowed.
    """
    span = int(seconds * 1_000_000)
    return fold_by_key(_timed(df, key, ts, row_id), key, "us", row_id, anchored_fold(limit, span), reset_us=span,
                       harmless=_within(limit, span), **tuning)


def rate_sliding(df: DataFrame, key: str, ts: str, row_id: str, limit: int, seconds: float, **tuning) -> DataFrame:
    """Sliding log that stores accepted requests only."""
    span = int(seconds * 1_000_000)
    return fold_by_key(_timed(df, key, ts, row_id), key, "us", row_id, sliding_fold(limit, span), reset_us=span,
                       harmless=_within(limit, span), **tuning)


def token_bucket(df: DataFrame, key: str, ts: str, row_id: str, capacity: int, per_second: float, **tuning) -> DataFrame:
    refill = round(1_000_000 / per_second)
    return fold_by_key(_timed(df, key, ts, row_id), key, "us", row_id, token_fold(capacity, refill), cost_us=refill,
                       harmless=_below(capacity * refill, refill), **tuning)


def leaky_bucket(df: DataFrame, key: str, ts: str, row_id: str, per_second: float, burst: int, **tuning) -> DataFrame:
    drain = round(1_000_000 / per_second)
    return fold_by_key(_timed(df, key, ts, row_id), key, "us", row_id, leaky_fold(burst, drain), cost_us=drain,
                       harmless=_below((burst + 1) * drain, drain), **tuning)


def decrement_by(stock: DataFrame, requests: DataFrame, key: str, quantity: str, wanted: str, ts: str, row_id: str, **tuning) -> DataFrame:
    """Sized requests in time order: accepted while the remaining stock covers them.

    A request for an unknown product is refused, unless it wants nothing.
    """
    rows = (requests.join(stock.select(key, F.col(quantity).cast("bigint").alias("_stock")), key, "left")
            .select(key, micros(ts).alias("us"), row_id, F.coalesce("_stock", F.lit(0)).alias("_stock"), F.col(wanted).cast("bigint").alias("_want")))
    return fold_by_key(rows, key, "us", row_id, stock_fold, amounts=["_stock", "_want"], harmless=_covered, **tuning)
