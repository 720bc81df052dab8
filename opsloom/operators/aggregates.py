"""Log and business aggregations.

Grouped counts and sums rely on Spark's partial aggregation: a hot key leaves each task
as one row, so no salting is needed before the shuffle. Top-k results use
``orderBy().limit()``, which keeps k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.ordered import first_n
from opsloom.functions.timeutil import column, floor_time, micros, ntz
from opsloom.operators.filters import where_last, where_status


def n_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(n_rows(name))


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Counts per key combination, largest first."""
    return df.groupBy(*keys).agg(n_rows(name)).orderBy(F.desc(name), *keys)


def count_by2(df: DataFrame, k1: str, k2: str, n: int, name: str = "n") -> DataFrame:
    return count_by(df, k1, k2, name=name).limit(n)


def top_k_by_count(df: DataFrame, key: str, n: int, name: str = "n") -> DataFrame:
    return count_by(df, key, name=name).limit(n)


def sums_by(df: DataFrame, keys: Sequence[str], sums: dict[str, str], count: str | None = None) -> DataFrame:
    """``{"total_bytes": "bytes"}`` sums and an optional row count per key combination."""
    aggs = [F.sum(source).alias(out) for out, source in sums.items()]
    return df.groupBy(*keys).agg(*aggs, *([n_rows(count)] if count else []))


def top(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


# --- flow logs ------------------------------------------------------------------------------

def top_talkers(flows: DataFrame, as_of: str, days: int = 7, n: int = 20) -> DataFrame:
    recent = where_last(flows, "date", days, as_of)
    return top(sums_by(recent, ["srcaddr"], {"total_bytes": "bytes", "total_packets": "packets"}), "total_bytes", n, "srcaddr")


def top_destinations(flows: DataFrame, as_of: str, days: int = 7, n: int = 20) -> DataFrame:
    recent = where_last(flows, "date", days, as_of)
    return top(sums_by(recent, ["dstaddr"], {"total_bytes": "bytes", "total_packets": "packets"}), "total_bytes", n, "dstaddr")


def top_ports(flows: DataFrame, n: int = 30, accepted_only: bool = False) -> DataFrame:
    chosen = flows.where(F.col("action") == "ACCEPT") if accepted_only else flows
    return top(sums_by(chosen, ["dstport"], {"total_bytes": "bytes"}, "flow_count"), "flow_count", n, "dstport")


def rejected(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("action") == "REJECT")


def rejected_traffic(flows: DataFrame) -> DataFrame:
    keys = ["srcaddr", "dstaddr", "dstport", "protocol"]
    return sums_by(rejected(flows), keys, {"packets": "packets", "bytes": "bytes"}).orderBy(F.desc("bytes"), *keys)


def rejected_counts(flows: DataFrame, as_of: str, days: int = 7, n: int = 100) -> DataFrame:
    recent = where_last(rejected(flows), "date", days, as_of)
    return count_by(recent, "srcaddr", "dstaddr", "dstport", name="rejected").limit(n)


def rejected_to_port(flows: DataFrame, port: int, protocol: str | int | None = None) -> DataFrame:
    hits = rejected(flows).where(F.col("dstport") == port)
    if protocol is not None:
        hits = hits.where(F.col("protocol") == protocol)
    return sums_by(hits, ["srcaddr", "dstaddr"], {"packets": "packets"}, "attempts")


def rejects_by(flows: DataFrame, key: str, n: int = 20) -> DataFrame:
    return top_k_by_count(rejected(flows), key, n, "rejected")


def most_rejected(flows: DataFrame, n: int = 50) -> DataFrame:
    return count_by2(rejected(flows), "dstaddr", "dstport", n, "rejected")


def port_breakdown(flows: DataFrame, port: int, protocol: str | int) -> DataFrame:
    hits = flows.where((F.col("dstport") == port) & (F.col("protocol") == protocol))
    keys = ["srcaddr", "dstaddr", "dstport", "protocol", "action"]
    return sums_by(hits, [*(["srcport"] if "srcport" in flows.columns else []), *keys], {"packets": "packets", "bytes": "bytes"})


def traffic_by(flows: DataFrame, *keys: str) -> DataFrame:
    return sums_by(flows, keys, {"total_bytes": "bytes"}, "flows").orderBy(F.desc("total_bytes"), *keys)


def top_interfaces(flows: DataFrame, n: int = 20) -> DataFrame:
    return top(sums_by(flows, ["interface_id"], {"total_bytes": "bytes"}), "total_bytes", n, "interface_id")


def flow_matrix(flows: DataFrame, start: str, end: str) -> DataFrame:
    inside = flows.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))
    return sums_by(inside, ["srcaddr", "dstaddr", "dstport"], {"total_bytes": "bytes"})


# --- access logs ----------------------------------------------------------------------------

def status_distribution(df: DataFrame) -> DataFrame:
    return count_by(df, "status", name="requests")


def top_failures(df: DataFrame, low: int, high: int, n: int, path: str = "path") -> DataFrame:
    return top_k_by_count(where_status(df, low, high), path, n, "failures")


def incident_breakdown(df: DataFrame, result: str = "cache") -> DataFrame:
    return count_by(where_status(df, 500, 599), "path", "status", result, name="requests")


def large_responses(df: DataFrame, n: int = 50) -> DataFrame:
    return top(sums_by(df, ["path"], {"total_bytes": "bytes"}, "requests"), "total_bytes", n, "path")


def bandwidth_gb(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.sum("bytes").cast("double") / (1 << 30), 2).alias("gb"))


def bandwidth_by_url(df: DataFrame, n: int = 20) -> DataFrame:
    mb = F.round(F.col("total").cast("double") / (1 << 20), 2)
    return top(sums_by(df, ["path"], {"total": "bytes"}), "total", n, "path").select("path", mb.alias("mb"))


def avg_response_time(df: DataFrame, rt: str = "rt") -> DataFrame:
    return df.agg(F.round(F.sum(rt).cast("double") / F.count(rt), 3).alias("seconds"))


def errors_by_severity(df: DataFrame, message: str = "message") -> DataFrame:
    # The five counted levels.
    level = F.regexp_extract(message, r"\[(emerg|alert|crit|error|warn)\]", 1)
    return count_by(df.withColumn("severity", level).where("severity <> ''"), "severity")


def requests_per(df: DataFrame, unit: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(floor_time(ts, unit).alias("slot")).agg(n_rows("requests"))


def page_views(df: DataFrame, page: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(page, column(ts).cast("date").alias("day")).agg(n_rows("views"))


def ip_profile(df: DataFrame, seconds: float, client: str = "client") -> DataFrame:
    """Requests, 4xx answers, unique paths and request rate per client and window."""
    return (df.groupBy(floor_time("ts", seconds).alias("slot"), client)
            .agg(n_rows("requests"), F.count_if(F.col("status").between(400, 499)).alias("client_errors"),
                 F.count_distinct("path").alias("paths"))
            .withColumn("rate", F.col("requests") / F.lit(float(seconds))))


# --- business tables ------------------------------------------------------------------------

def category_performance(lines: DataFrame, category: str, amount: str, order_id: str) -> DataFrame:
    mean = F.sum(amount).cast("double") / F.count(amount)
    return lines.groupBy(category).agg(mean.alias("avg_amount"), F.count_distinct(order_id).alias("orders"))


def inventory_value(products: DataFrame) -> DataFrame:
    value = F.sum(F.col("price") * F.col("stock"))
    return products.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("total_value"))


def cart_totals(lines: DataFrame, cart: str = "user_id") -> DataFrame:
    """Per cart: item count, quantity and rounded total, all in decimals."""
    total = F.round(F.sum(F.col("price") * F.col("quantity")), 2)
    return lines.groupBy(cart).agg(n_rows("lines"), F.sum("quantity").alias("items"), total.alias("total"))


def cart_state(events: DataFrame, keys: Sequence[str], quantity: str, order: Sequence[str], mode: str = "add") -> DataFrame:
    """Quantity per cart line: ``add`` accumulates, ``overwrite`` keeps the last event's."""
    if mode == "add":
        return events.groupBy(*keys).agg(F.sum(quantity).alias("quantity"))
    return events.groupBy(*keys).agg(F.max_by(quantity, F.struct(*order)).alias("quantity"))


def counters(events: DataFrame, keys: Sequence[str], delta: str | Column) -> DataFrame:
    return events.groupBy(*keys).agg(F.sum(column(delta)).alias("value"))


def latest_n_nested(child: DataFrame, key: str, order: Sequence[str], row_id: str, fields: Sequence[str], n: int) -> DataFrame:
    """Array of each parent's latest ``n`` children; the cut comes before the collect."""
    newest = first_n(child, [key], [F.desc(c) for c in order], n, F.col(row_id), out="_rn")
    packed = F.array_sort(F.collect_list(F.struct("_rn", *fields)))
    return newest.groupBy(key).agg(F.transform(packed, lambda s: s.dropFields("_rn")).alias("latest"))


def contributors(df: DataFrame, key: str, n: int) -> DataFrame:
    """Top contributors with their share of all rows."""
    counted = df.groupBy(key).agg(n_rows("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.orderBy(F.desc("n"), key).limit(n).select(key, "n", (F.col("n") / total).alias("share"))


def skew_report(df: DataFrame, key: str, n: int) -> DataFrame:
    """Heaviest keys with their share and the ratio to the mean key."""
    counted = df.groupBy(key).agg(n_rows("n"))
    total = counted.agg(F.sum("n")).scalar()
    mean = counted.agg(F.sum("n") / F.count(F.lit(1))).scalar()
    return counted.orderBy(F.desc("n"), key).limit(n).select(
        key, "n", (F.col("n") / total).alias("share"), (F.col("n") / mean).alias("times_mean"))


def capacity(df: DataFrame, seconds: float, unit: str, per_partition: float, ts: str = "ts") -> DataFrame:
    """Peak and average throughput per second, and partitions needed for the peak."""
    rate = (F.sum(unit).cast("double") / F.lit(float(seconds))).alias("rate")
    slots = df.groupBy(floor_time(ts, seconds).alias("slot")).agg(rate)
    # Sums are rounded so that the order of addition cannot show.
    return (slots.agg(F.max("rate").alias("peak"), F.round(F.sum("rate") / F.count("rate"), 6).alias("average"))
            .withColumn("partitions", F.ceil(F.col("peak") / F.lit(float(per_partition))).cast("bigint")))


def slow_statements(df: DataFrame, statement: str, elapsed: str, n: int = 10) -> DataFrame:
    mean = F.round(F.sum(elapsed).cast("double") / F.count(elapsed), 2)
    stats = df.groupBy(statement).agg(n_rows("calls"), F.sum(elapsed).alias("total_time"), mean.alias("mean_time"))
    return top(stats, "mean_time", n, statement)


def dead_pct(df: DataFrame, dead: str, live: str, min_dead: int, n: int) -> DataFrame:
    """Dead-row share in percent; null when a table has no rows at all."""
    pct = F.round(F.try_divide(F.col(dead) * F.lit(100.0), F.nullif(F.col(dead) + F.col(live), F.lit(0))), 2)
    return top(df.withColumn("dead_pct", pct).where(F.col(dead) > min_dead), dead, n, *[c for c in df.columns if c not in (dead, live)])


def big_values(df: DataFrame, kind: str, key: str, value: str) -> DataFrame:
    """Count, total bytes and largest member per type."""
    size = F.octet_length(value).cast("bigint")
    return df.groupBy(kind).agg(n_rows("n"), F.sum(size).alias("total_bytes"),
                                F.max_by(key, F.struct(size, F.col(key))).alias("largest"))


def long_running(df: DataFrame, started: str, state: str, as_of: str) -> DataFrame:
    """Statements that are not idle, oldest first, with their age in seconds."""
    age = ((micros(ntz(as_of)) - micros(started)) / 1_000_000).cast("bigint")
    return df.where(F.col(state) != "idle").withColumn("age_s", age).orderBy(F.desc("age_s"))


def unused(df: DataFrame, counter: str, name: str, exclude: str, size: str) -> DataFrame:
    return df.where((F.col(counter) == 0) & ~F.col(name).contains(exclude)).orderBy(F.desc(size))


def unit_cost(cost: DataFrame, usage: DataFrame, by: str, user: str) -> DataFrame:
    """Cost per 1,000 requests and per active user."""
    spent = cost.groupBy(by).agg(F.sum("cost").cast("double").alias("_cost"))
    used = usage.groupBy(by).agg(n_rows("_requests"), F.count_distinct(user).alias("_users"))
    return spent.join(used, by, "left").select(
        by, F.try_divide(F.col("_cost") * 1000, F.col("_requests")).alias("per_1000"),
        F.try_divide(F.col("_cost"), F.col("_users")).alias("per_user"))
