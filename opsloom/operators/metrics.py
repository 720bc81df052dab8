"""Metrics, distinct-count sketches, rates, baselines and alarms."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.ordered import previous
from opsloom.functions.timeutil import column, floor_time, from_micros, micros, time_chunk
from opsloom.operators.aggregates import n_rows

# Fixed value: 2**14 registers give the 0.81 % standard error of the distinct counter.
HLL_PRECISION = 14
# Size of the compactor levels: a sketch errs by 0.4 % of the rank or less in 99 of 100 cases and holds some 20 KB.
KLL_SIZE = 800


# --- distinct counts --------------------------------------------------------------------------

def unique_registers(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """A mergeable sketch per key, as rows ``(keys, register, rho)``: at most ``2**HLL_PRECISION`` rows a key.

    The first 52 bits of the member's MD5 give the register and the place of the first set bit, so other engines can
    reproduce the estimate. Null members don't count.
    """
    rest_bits = 52 - HLL_PRECISION
    digest = F.conv(F.substring(F.md5(F.col(member).cast("string").cast("binary")), 1, 13), 16, 10).cast("bigint")
    rest = F.pmod("_h", F.lit(1 << rest_bits))
    rho = F.when(rest == 0, rest_bits + 1).otherwise(rest_bits + 1 - F.length(F.bin(rest)))
    hashed = df.where(F.col(member).isNotNull()).withColumn("_h", digest)
    return hashed.groupBy(*keys, F.shiftright("_h", rest_bits).alias("register")).agg(F.max(rho).alias("rho"))


def merge_registers(registers: DataFrame, *keys: str) -> DataFrame:
    """Daily sketches merged into longer periods, without touching the raw rows."""
    return registers.groupBy(*keys, "register").agg(F.max("rho").alias("rho"))


def estimate_uniques(registers: DataFrame, *keys: str) -> DataFrame:
    """The distinct counts that the registers stand for (standard error 0.81 %), rounded."""
    m = float(1 << HLL_PRECISION)
    sums = registers.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("_s"), n_rows("_n"))
    empty = F.lit(m) - F.col("_n")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("_s") + empty)
    small = (raw <= 2.5 * m) & (empty > 0)
    return sums.select(*keys, F.round(F.when(small, m * F.log(m / empty)).otherwise(raw)).cast("bigint").alias("uniques"))


def unique_visitors(df: DataFrame, member: str, *keys: str) -> DataFrame:
    return estimate_uniques(unique_registers(df, keys, member), *keys)


def login_bitmaps(df: DataFrame, user: str, day: str) -> DataFrame:
    """One fixed-size bitmap per day and id range; a repeated login sets the same bit."""
    bucket = F.bitmap_bucket_number(user).alias("bucket")
    return df.groupBy(day, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(user)).alias("bits"))


def dau(df: DataFrame, user: str, day: str) -> DataFrame:
    return login_bitmaps(df, user, day).groupBy(day).agg(F.sum(F.bitmap_count("bits")).alias("active"))


def was_active(df: DataFrame, user: str, day: str, user_id: int, on: str) -> DataFrame:
    hit = (F.col(user) == user_id) & (F.col(day) == F.lit(on).cast("date"))
    return df.where(hit).agg((F.count(F.lit(1)) > 0).alias("active"))


def analytics_summary(views: DataFrame, logins: DataFrame, names: DataFrame, n: int = 10) -> DataFrame:
    """Unique visitors, active users and the views of the top ``n`` products, in one row.

    ``views(product_id, visitor_id)``, ``logins(user_id)``, ``names(product_id, name)``.
    """
    leaders = (views.groupBy("product_id").agg(n_rows("views"))
               .orderBy(F.desc("views"), F.desc(F.col("product_id").cast("string"))).limit(n)
               .join(names, "product_id", "left")
               .withColumn("name", F.coalesce("name", F.concat(F.lit("Product "), F.col("product_id").cast("string")))))
    packed = F.array_sort(F.collect_list(F.struct((-F.col("views")).alias("rank"), "name")))
    top = leaders.agg(F.sum("views").alias("total_views"),
                      F.array_join(F.transform(packed, lambda s: s["name"]), ",").alias("top_products"))
    return top.select("*", views.agg(F.count_distinct("visitor_id")).scalar().alias("unique_visitors"),
                      logins.agg(F.count_distinct("user_id")).scalar().alias("daily_active_users"))


# --- statistics per period --------------------------------------------------------------------

def metric_stats(df: DataFrame, value: str, seconds: float, dims: Sequence[str], ts: str = "ts") -> DataFrame:
    """Average, Sum, Minimum, Maximum and SampleCount per period and dimensions."""
    return df.groupBy(floor_time(ts, seconds).alias("period"), *dims).agg(
        (F.sum(value).cast("double") / F.count(value)).alias("average"), F.sum(value).alias("sum"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count(value).alias("sample_count"))


def latency_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Percentiles from a bounded-size summary per group: error at most 1/accuracy of the group's rank."""
    # Percentiles run on doubles: the answer is always one of the input values.
    picked = F.percentile_approx(F.col(value).cast("double"), list(qs), accuracy)
    return df.groupBy(*keys).agg(picked.alias("_p")).select(
        *keys, *[F.col("_p")[i].alias(_pname(q)) for i, q in enumerate(qs)])


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], width: float) -> DataFrame:
    """Nearest-rank percentiles as rows ``(keys, q, value)``, exact for groups of any size.

    A histogram finds the slot of ``width`` that holds each rank; only rows of those slots
    are counted by value. No task ever holds all rows of a group. Null values don't count; null keys are one group.
    """
    keys = list(keys)
    slotted = df.where(F.col(value).isNotNull()).select(*keys, value, F.floor(F.col(value) / F.lit(width)).alias("_slot"))
    slotted = slotted.withColumn("_place", F.struct(*keys, "_slot"))  # joins on a struct keep null keys
    upto = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    sizes = slotted.groupBy(*keys, "_slot", "_place").agg(n_rows("_n"))
    ranked = (sizes.withColumn("_upto", F.sum("_n").over(upto))
              .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
              .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
              .withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("_total"))))
              .where((F.col("_upto") - F.col("_n") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
              .select("_place", "q", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_local")))
    inside = Window.partitionBy("_place").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    by_value = (slotted.join(ranked.select("_place").distinct(), "_place", "left_semi")
                .groupBy("_place", *keys, value).agg(n_rows("_n")).withColumn("_seen", F.sum("_n").over(inside)))
    hit = (F.col("_seen") - F.col("_n") < F.col("_local")) & (F.col("_local") <= F.col("_seen"))
    return by_value.join(ranked, "_place").where(hit).select(*keys, "q", value)


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, size: int = KLL_SIZE) -> DataFrame:
    """A quantile sketch (compactor levels) per key, as rows ``(keys, sketch)`` to be stored; null values don't count."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merge_sketches(sketches: DataFrame, *keys: str, size: int = KLL_SIZE) -> DataFrame:
    """Sketches of short periods merged into longer ones, without touching the raw rows."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """``(keys, n, q, value)``: the number of values and each quantile; none for a sketch without values."""
    held = sketches.select(*keys, "sketch", F.kll_sketch_get_n_double("sketch").alias("n")).where("n > 0")
    picked = [F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value")) for q in qs]
    return held.select(*keys, "n", F.explode(F.array(*picked)).alias("_p")).select(*keys, "n", "_p.q", "_p.value")


def rank_errors(df: DataFrame, keys: Sequence[str], value: str, quantiles: DataFrame) -> DataFrame:
    """``(keys, n, q, value, error)``: how far each estimate's exact ranks lie from ``q``, as a share of the rows.

    An estimate owns the ranks from the values below it to the values up to it; inside them the error is 0. The rows meet
    all estimates of their key at once and leave each task as counts. Null keys are one group.
    """
    keys = list(keys)
    known = quantiles.groupBy(F.struct(*keys).alias("_key")).agg(F.collect_list(F.struct("q", F.col("value").alias("estimate"))).alias("_asked"))
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_value"))
    counts = rows.groupBy("_key", "_value").agg(n_rows("_n")).join(known, "_key").select("*", F.explode("_asked").alias("_one"))
    below = F.sum(F.when(F.col("_value") < F.col("_one.estimate"), F.col("_n")).otherwise(0))
    upto = F.sum(F.when(F.col("_value") <= F.col("_one.estimate"), F.col("_n")).otherwise(0))
    ranked = counts.groupBy("_key", "_one").agg(F.sum("_n").alias("n"), below.alias("_below"), upto.alias("_upto"))
    error = F.greatest(F.lit(0.0), F.col("_below") / F.col("n") - F.col("_one.q"), F.col("_one.q") - F.col("_upto") / F.col("n"))
    return ranked.select("_key.*", "n", F.col("_one.q").alias("q"), F.col("_one.estimate").alias("value"), error.alias("error"))


def _pname(q: float) -> str:
    return f"p{q * 100:g}".replace(".", "_")


def error_rates(df: DataFrame, keys: Sequence[str] = (), status: str = "status") -> DataFrame:
    """4xx, 5xx and total error rates in percent."""
    s, total = F.col(status), F.count(F.lit(1))
    pct = lambda hit: F.count_if(hit) * F.lit(100.0) / total
    return df.groupBy(*keys).agg(pct(s.between(400, 499)).alias("rate_4xx"), pct(s.between(500, 599)).alias("rate_5xx"),
                                 pct(s.between(400, 599)).alias("rate_total"))


def status_rate(df: DataFrame, codes: Sequence[int], status: str = "status") -> DataFrame:
    total = F.count(F.lit(1))
    return df.agg(*[(F.count_if(F.col(status) == c) * F.lit(100.0) / total).alias(f"rate_{c}") for c in codes])


def cache_hit_rate(df: DataFrame, cache: str = "cache", method: str = "method", status: str = "status") -> DataFrame:
    """Hits per cacheable request in percent: POST, PUT and error answers do not count."""
    cacheable = ~F.col(method).isin("POST", "PUT") & (F.col(status) < 400)
    hits = F.count_if(cacheable & (F.col(cache) == "HIT"))
    return df.agg(F.try_divide(hits * F.lit(100.0), F.count_if(cacheable)).alias("hit_rate"))


def slo(df: DataFrame, good: Column, target: float, keys: Sequence[Column | str] = ()) -> DataFrame:
    """Availability, compliance and the unspent part of the error budget (1 = untouched)."""
    stats = df.groupBy(*keys).agg(F.count_if(good).alias("good"), n_rows("total"))
    failed = F.col("total") - F.col("good")
    available = F.col("good") / F.col("total")
    budget = F.lit(1.0) - F.try_divide(failed.cast("double"), F.lit(1.0 - target) * F.col("total"))
    return (stats.withColumn("availability", available).withColumn("met", F.col("availability") >= target)
            .withColumn("budget_left", F.round(budget, 6)))


def metric_math(df: DataFrame, period: str, series: str, value: str, names: Sequence[str], expr: str, out: str = "result") -> DataFrame:
    """Expression over aligned series, e.g. ``(cpu_a + cpu_b) / 2``."""
    wide = df.groupBy(period).pivot(series, list(names)).agg(F.first(value))
    return wide.select(period, F.expr(expr).alias(out))


# --- baselines --------------------------------------------------------------------------------

def baseline_shift(current: DataFrame, baseline: DataFrame, key: str, points: float) -> DataFrame:
    """Share of rows per key now and in the baseline, flagged when it moved by ``points`` percent or more."""
    def shares(df: DataFrame, out: str) -> DataFrame:
        counted = df.groupBy(key).agg(n_rows("_n"))
        total = counted.agg(F.sum("_n")).scalar()
        return counted.select(key, (F.col("_n") * F.lit(100.0) / total).alias(out))

    both = shares(current, "current_pct").join(shares(baseline, "baseline_pct"), key, "full_outer")
    both = both.fillna(0.0, ["current_pct", "baseline_pct"])
    return both.withColumn("shifted", F.abs(F.col("current_pct") - F.col("baseline_pct")) >= points)


def port_scans(flows: DataFrame, seconds: float, limit: int, ts: str = "start") -> DataFrame:
    """Source-destination pairs that touched more than ``limit`` ports in one window (limit is ours)."""
    return (flows.groupBy(floor_time(ts, seconds).alias("slot"), "srcaddr", "dstaddr")
            .agg(F.count_distinct("dstport").alias("ports")).where(F.col("ports") > limit))


def trailing_baseline(counts: DataFrame, keys: Sequence[str], period: str, value: str, periods: int, seconds: float) -> DataFrame:
    """Mean and sample deviation over the ``periods`` periods before this one, as far as the key's series reaches back.

    ``counts`` holds one row per key and period with rows, so a key's rows stay few; a silent period counts as 0.
    """
    numbered = F.floor(micros(period) / F.lit(int(seconds * 1_000_000)))
    counts = counts.withColumn("_number", numbered)
    every = Window.partitionBy(*keys)
    before = every.orderBy("_number").rangeBetween(-periods, -1)
    n = F.least(F.lit(periods), F.col("_number") - F.min("_number").over(every))
    total = F.coalesce(F.sum(value).over(before), F.lit(0))
    squares = F.coalesce(F.sum(F.col(value) * F.col(value)).over(before), F.lit(0))
    stats = counts.withColumns({"_n": n, "_sum": total, "_squares": squares})
    variance = F.try_divide((F.col("_n") * F.col("_squares") - F.col("_sum") * F.col("_sum")).cast("double"),
                            F.col("_n") * (F.col("_n") - 1))
    return (stats.withColumn("baseline", F.try_divide(F.col("_sum").cast("double"), F.col("_n")))
            .withColumn("deviation", F.sqrt(variance)).drop("_n", "_sum", "_squares", "_number"))


def volume_anomalies(df: DataFrame, keys: Sequence[str], seconds: float, periods: int, ratio: float, ts: str = "ts") -> DataFrame:
    """Periods whose row count is at least ``ratio`` times the trailing mean (D54, D62; ratio is ours)."""
    counts = df.groupBy(floor_time(ts, seconds).alias("period"), *keys).agg(n_rows("n"))
    judged = trailing_baseline(counts, keys, "period", "n", periods, seconds)
    return judged.where(F.col("n") >= F.col("baseline") * ratio).drop("deviation")


# --- alarms and gaps --------------------------------------------------------------------------

def alarm(series: DataFrame, keys: Sequence[str], period: str, value: str, seconds: int, threshold: float, n: int, m: int) -> DataFrame:
    """M-of-N alarm state per period, silent periods included (their ``value`` is null).

    ``series`` has one row per key and period. The grid from a key's first period to its last is made dense first, a
    thousand periods at a time; a missing period does not breach. ALARM when m of the last n breach, else
    INSUFFICIENT_DATA when one of the n is missing (our rule), else OK. Rows without a period are left out.
    """
    width = int(seconds * 1_000_000)
    series = series.where(F.col(period).isNotNull())
    slots = series.groupBy(*keys).agg(F.min(micros(period)).alias("_lo"), F.max(micros(period)).alias("_hi"))
    runs = slots.withColumn("_from", F.explode(F.sequence("_lo", "_hi", F.lit(width * 1000))))
    upto = F.least(F.col("_hi"), F.col("_from") + width * 999)
    grid = runs.select(*keys, F.explode(F.sequence("_from", upto, F.lit(width))).alias("_us"))
    rest = [c for c in series.columns if c not in keys and c != period]
    known = series.select(F.struct(*keys, micros(period).alias("_us")).alias("_place"), *rest)
    dense = (grid.withColumn("_place", F.struct(*keys, "_us")).join(known, "_place", "left").drop("_place")
             .withColumn(period, from_micros("_us").cast(series.schema[period].dataType)))
    last = Window.partitionBy(*keys).orderBy("_us").rowsBetween(-(n - 1), 0)
    breaches = F.count_if(F.col(value) > threshold).over(last)
    present = F.count(value).over(last)
    state = F.when(breaches >= m, "ALARM").when(present < n, "INSUFFICIENT_DATA").otherwise("OK")
    return dense.withColumn("state", state).drop("_us")


def composite(states: DataFrame, by: str, name: str, names: Sequence[str], rule: str) -> DataFrame:
    """``ALARM(cpu) AND NOT ALARM(disk)`` over the states of one period."""
    wide = states.groupBy(by).pivot(name, list(names)).agg(F.first("state"))
    condition = re.sub(r"\b(ALARM|OK|INSUFFICIENT_DATA)\((\w+)\)", r"coalesce(`\2` = '\1', false)", rule)
    return wide.select(by, F.when(F.expr(condition), "ALARM").otherwise("OK").alias("state"))


def gaps(df: DataFrame, keys: Sequence[str], ts: str, tie: str, max_seconds: float, chunk_seconds: float = 86400) -> DataFrame:
    """Rows that arrived more than ``max_seconds`` after the key's row before them."""
    lagged = previous(df, keys, [ts, tie], time_chunk(ts, chunk_seconds), {"previous_ts": column(ts)})
    silence = (micros(ts) - micros("previous_ts")) / F.lit(1_000_000)
    return lagged.where(silence > max_seconds).withColumn("gap_s", F.floor(silence).cast("bigint"))


def order_violations(df: DataFrame, partition: str, ts: str, offset: str, chunk_seconds: float = 600, fan: int = 1000) -> DataFrame:
    """Per partition in arrival order: offsets that skip (gap) or go back (disorder).

    ``chunk_seconds`` of a partition are one task's; ends of ``fan`` chunks are carried on together.
    """
    chunk = F.floor(micros(ts) / int(chunk_seconds * 1_000_000))
    lagged = previous(df, [partition], [ts, offset], chunk, {"previous_offset": F.col(offset)}, fan)
    kind = F.when(F.col(offset) <= F.col("previous_offset"), "disorder").when(
        F.col(offset) != F.col("previous_offset") + 1, "gap")
    return lagged.withColumn("violation", kind).where(F.col("violation").isNotNull())


def spikes(df: DataFrame, seconds: float, threshold: int, keep: Mapping[str, object], ts: str = "ts") -> DataFrame:
    """Windows with at least ``threshold`` rows that equal ``keep``."""
    for name, wanted in keep.items():
        df = df.where(F.col(name) == wanted)
    return df.groupBy(floor_time(ts, seconds).alias("slot")).agg(n_rows("n")).where(F.col("n") >= threshold)
