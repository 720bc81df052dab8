"""Registered queries: sketches, statistics, baselines and alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.timeutil import floor_time
from opsloom.operators import metrics as op
from opsloom.plans.registry import query
from opsloom.plans.roles import EV, EV_GAPS, FLOW, PRODUCTS, WEB, ev, ev_gaps, flow, products, sql, web
from opsloom.session import cut_lineage


def _registers(key: str, member: str, table: str) -> str:
    """The same registers and estimate as the operator, for SQL."""
    return f"""WITH h AS (SELECT {key} AS k, CAST('0x' || substr(md5(CAST({member} AS VARCHAR)), 1, 13) AS BIGINT) AS h FROM {table}),
r AS (SELECT k, h >> 38 AS register, max(CASE WHEN h % 274877906944 = 0 THEN 39 ELSE 39 - length(bin(h % 274877906944)) END) AS rho FROM h GROUP BY 1, 2),
s AS (SELECT k, sum(pow(2.0::DOUBLE, -rho)) AS s, 16384 - count(*) AS e FROM r GROUP BY 1),
u AS (SELECT k, e, 0.7213::DOUBLE / (1 + 1.079::DOUBLE / 16384.0::DOUBLE) * 16384.0::DOUBLE * 16384.0::DOUBLE / (s + e) AS raw FROM s),
uniques AS (SELECT k, CAST(round(CASE WHEN raw <= 40960 AND e > 0 THEN 16384.0::DOUBLE * ln(16384.0::DOUBLE / e) ELSE raw END) AS BIGINT) AS uniques FROM u)
"""


@query("D29", _registers("event_type", "user_id", "events") + "SELECT k AS event_type, uniques FROM uniques")
def unique_visitors(t):
    return op.unique_visitors(t.events, "user_id", "event_type")


@query("D30", _registers("date_trunc('month', l_shipdate)", "l_orderkey", "lineitem") + "SELECT k AS month, uniques FROM uniques")
def merged_uniques(t):
    month = F.make_timestamp_ntz(F.year("l_shipdate"), F.month("l_shipdate"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    days = t.lineitem.select(F.col("l_shipdate").cast("date").alias("day"), month.alias("month"), "l_orderkey")
    daily = op.unique_registers(days, ["day", "month"], "l_orderkey")
    return op.estimate_uniques(op.merge_registers(daily, "month"), "month")


def _logins(t):
    return t.events.select("user_id", F.col("ts").cast("date").alias("day"))


@query("D31", "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS active FROM events GROUP BY 1")
def daily_active_users(t):
    return op.dau(_logins(t), "user_id", "day")


@query("D31", "SELECT CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_custkey) AS active FROM orders GROUP BY 1")
def daily_active_customers(t):
    return op.dau(t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("day")), "o_custkey", "day")


@query("D32", "SELECT count(*) > 0 AS active FROM events WHERE user_id = 7 AND CAST(ts AS DATE) = DATE '2024-01-12'")
def was_user_active(t):
    return op.was_active(_logins(t), "user_id", "day", 7, "2024-01-12")


@query("D33 C5", sql(EV, PRODUCTS, """leaders AS (SELECT k, count(*) AS views FROM ev WHERE event_type = 'view' GROUP BY 1
  ORDER BY 2 DESC, CAST(k AS VARCHAR) DESC LIMIT 10)""") + """
SELECT (SELECT count(DISTINCT user_id) FROM ev WHERE event_type = 'view') AS unique_visitors,
 (SELECT count(DISTINCT user_id) FROM ev WHERE CAST(ts AS DATE) = DATE '2024-01-30') AS daily_active_users,
 CAST(sum(views) AS BIGINT) AS total_views,
 string_agg(coalesce(name, 'Product ' || k), ',' ORDER BY views DESC, coalesce(name, 'Product ' || k)) AS top_products
FROM leaders LEFT JOIN products ON id = k AND stock > 25""")
def analytics_summary(t):
    views = ev(t).where(F.col("event_type") == "view").select(F.col("k").cast("bigint").alias("product_id"),
                                                              F.col("user_id").alias("visitor_id"))
    logins = _logins(t).where(F.col("day") == F.lit("2024-01-30").cast("date"))
    names = products(t).where("stock > 25").select(F.col("id").alias("product_id"), "name")
    return op.analytics_summary(views, logins, names)


@query("D35", sql(EV) + """SELECT date_trunc('hour', ts) AS period, event_type, CAST(sum(value) AS DOUBLE) / count(*) AS average,
CAST(sum(value) AS DOUBLE) AS sum, CAST(min(value) AS DOUBLE) AS minimum, CAST(max(value) AS DOUBLE) AS maximum,
count(*) AS sample_count FROM ev GROUP BY 1, 2""")
def metric_statistics(t):
    return op.metric_stats(ev(t), "value", 3600, ["event_type"])


PCT = """r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM ev)"""


@query("D36", sql(EV, PCT) + """SELECT event_type, q, CAST(value AS DOUBLE) AS value FROM r
JOIN (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS q) ON rn = greatest(1, ceil(q * n))""")
def latency_percentiles_exact(t):
    return op.exact_percentiles(ev(t), ["event_type"], "value", [0.5, 0.9, 0.95, 0.99], width=5.0)


@query("D36", sql(EV_GAPS) + """, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS rn,
  count(*) OVER (PARTITION BY user_id) AS n FROM ev_gaps)
SELECT user_id, q, CAST(value AS DOUBLE) AS value FROM r JOIN (SELECT unnest([0.5, 0.95])::DOUBLE AS q) ON rn = greatest(1, ceil(q * n))""")
def percentiles_with_null_group(t):
    return op.exact_percentiles(ev_gaps(t), ["user_id"], "value", [0.5, 0.95], width=5.0)


@query("D36")
def latency_percentiles(t):
    return op.latency_percentiles(ev(t), ["event_type"], "value", [0.5, 0.9, 0.95, 0.99])


QUANTILES = "(SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS q)"


@query("D36", sql(EV) + f"""SELECT event_type, q, n, true AS within FROM (SELECT event_type, count(value) AS n FROM ev GROUP BY 1), {QUANTILES}""")
def merged_percentiles(t):
    # Sketches of days, merged to the whole time; each estimate is held against the exact ranks.
    days = ev(t).withColumn("day", F.col("ts").cast("date"))
    merged = op.merge_sketches(op.quantile_sketches(days, ["event_type", "day"], "value"), "event_type")
    found = op.rank_errors(days, ["event_type"], "value", op.sketch_quantiles(merged, ["event_type"], [0.5, 0.9, 0.95, 0.99]))
    return found.select("event_type", "q", "n", (F.col("error") <= 0.01).alias("within"))


@query("D36", f"""SELECT l_returnflag, q, n, true AS within FROM (SELECT l_returnflag, count(l_extendedprice) AS n FROM lineitem GROUP BY 1), {QUANTILES}""")
def merged_price_percentiles(t):
    months = t.lineitem.select("l_returnflag", F.trunc("l_shipdate", "month").alias("month"), "l_extendedprice")
    stored = cut_lineage(op.quantile_sketches(months, ["l_returnflag", "month"], "l_extendedprice"))
    found = op.sketch_quantiles(op.merge_sketches(stored, "l_returnflag"), ["l_returnflag"], [0.5, 0.9, 0.95, 0.99])
    return op.rank_errors(months, ["l_returnflag"], "l_extendedprice", found).select("l_returnflag", "q", "n", (F.col("error") <= 0.01).alias("within"))


@query("D38", sql(WEB) + """SELECT edge, count(*) FILTER (status BETWEEN 400 AND 499) * 100.0::DOUBLE / count(*) AS rate_4xx,
count(*) FILTER (status BETWEEN 500 AND 599) * 100.0::DOUBLE / count(*) AS rate_5xx,
count(*) FILTER (status BETWEEN 400 AND 599) * 100.0::DOUBLE / count(*) AS rate_total FROM web GROUP BY 1""")
def error_rates_by_edge(t):
    return op.error_rates(web(t), ["edge"])


@query("D38", sql(WEB) + """SELECT count(*) FILTER (status = 404) * 100.0::DOUBLE / count(*) AS rate_404,
count(*) FILTER (status = 500) * 100.0::DOUBLE / count(*) AS rate_500 FROM web""")
def single_status_rates(t):
    return op.status_rate(web(t), [404, 500])


@query("D39", sql(WEB) + """SELECT count(*) FILTER (cache = 'HIT' AND method <> 'POST' AND status < 400) * 100.0::DOUBLE
/ count(*) FILTER (method <> 'POST' AND status < 400) AS hit_rate FROM web""")
def cache_hit_rate(t):
    return op.cache_hit_rate(web(t))


@query("D41", sql(FLOW) + """, c AS (SELECT dstport, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM flow WHERE "date" >= DATE '1999-01-01')
  AS p FROM flow WHERE "date" >= DATE '1999-01-01' GROUP BY 1),
b AS (SELECT dstport, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM flow WHERE "date" < DATE '1999-01-01') AS p
  FROM flow WHERE "date" < DATE '1999-01-01' GROUP BY 1)
SELECT coalesce(c.dstport, b.dstport) AS dstport, coalesce(c.p, 0) AS current_pct, coalesce(b.p, 0) AS baseline_pct,
abs(coalesce(c.p, 0) - coalesce(b.p, 0)) >= 0.2 AS shifted FROM c FULL JOIN b ON c.dstport = b.dstport""")
def port_share_shift(t):
    since = F.lit("1999-01-01").cast("date")
    return op.baseline_shift(flow(t).where(F.col("date") >= since), flow(t).where(F.col("date") < since), "dstport", 0.2)


@query("D42", sql(FLOW) + """SELECT make_timestamp(epoch_us(start) // 31536000000000 * 31536000000000) AS slot, srcaddr, dstaddr,
count(DISTINCT dstport) AS ports FROM flow GROUP BY 1, 2, 3 HAVING count(DISTINCT dstport) > 1""")
def port_scans(t):
    return op.port_scans(flow(t), 365 * 86400, 1)


@query("D46", sql(EV) + """, s AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT day, (max(CASE WHEN event_type = 'view' THEN n END) + max(CASE WHEN event_type = 'click' THEN n END)) / 2::DOUBLE AS mean_load
FROM s GROUP BY 1""")
def metric_math(t):
    series = t.events.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return op.metric_math(series, "day", "event_type", "n", ["view", "click"], "(view + click) / 2", "mean_load")


@query("D54", sql(EV) + """, c AS (SELECT date_trunc('hour', ts) AS period, event_type, count(*) AS n FROM ev GROUP BY 1, 2),
p AS (SELECT *, epoch_us(period) // 3600000000 AS k FROM c),
b AS (SELECT *, coalesce(sum(n) OVER w, 0) / nullif(least(24, k - min(k) OVER (PARTITION BY event_type)), 0) AS baseline FROM p
  WINDOW w AS (PARTITION BY event_type ORDER BY k RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT period, event_type, n, baseline FROM b WHERE n >= baseline * 1.25::DOUBLE""")
def query_volume_spikes(t):
    return op.volume_anomalies(t.events, ["event_type"], 3600, 24, 1.25)


@query("D62", sql(FLOW) + """, c AS (SELECT date_trunc('day', start) AS period, dstport, count(*) AS n FROM flow WHERE action = 'REJECT' GROUP BY 1, 2),
p AS (SELECT *, epoch_us(period) // 86400000000 AS k FROM c),
b AS (SELECT *, coalesce(sum(n) OVER w, 0) / nullif(least(30, k - min(k) OVER (PARTITION BY dstport)), 0) AS baseline FROM p
  WINDOW w AS (PARTITION BY dstport ORDER BY k RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT period, dstport, n, baseline FROM b WHERE n >= baseline * 1.5::DOUBLE""")
def reject_spikes(t):
    return op.volume_anomalies(flow(t).where(F.col("action") == "REJECT"), ["dstport"], 86400, 30, 1.5, "start")


@query("D60", sql(WEB) + """, s AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (status < 500) AS good, count(*) AS total FROM web GROUP BY 1)
SELECT day, good, total, good / total AS availability, good / total >= 0.9 AS met,
round(1.0 - (total - good) / ((1.0::DOUBLE - 0.9::DOUBLE) * total), 6) AS budget_left FROM s""")
def availability_objective(t):
    return op.slo(web(t), F.col("status") < 500, 0.9, [F.col("ts").cast("date").alias("day")])


ALARM = """p AS (SELECT date_trunc('hour', ts) AS period, event_type, CAST(sum(value) AS DOUBLE) AS load FROM ev GROUP BY 1, 2),
g AS (SELECT event_type, unnest(generate_series(min(period), max(period), INTERVAL 1 HOUR)) AS period FROM p GROUP BY 1),
d AS (SELECT g.event_type, g.period, p.load FROM g LEFT JOIN p ON g.event_type = p.event_type AND g.period = p.period),
states AS (SELECT event_type, period, load, CASE WHEN count(*) FILTER (load > 150) OVER w >= 3 THEN 'ALARM'
  WHEN count(load) OVER w < 5 THEN 'INSUFFICIENT_DATA' ELSE 'OK' END AS state FROM d
  WINDOW w AS (PARTITION BY event_type ORDER BY period ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def _alarms(t):
    hourly = ev(t).groupBy(floor_time("ts", 3600).alias("period"), "event_type").agg(F.sum("value").cast("double").alias("load"))
    return op.alarm(hourly, ["event_type"], "period", "load", 3600, 150.0, 5, 3)


@query("E16", sql(EV, ALARM) + "SELECT event_type, period, load, state FROM states")
def alarm_states(t):
    return _alarms(t)


@query("E17", sql(EV, ALARM) + """SELECT period, CASE WHEN bool_or(event_type = 'view' AND state = 'ALARM')
AND NOT bool_or(event_type = 'purchase' AND state = 'ALARM') THEN 'ALARM' ELSE 'OK' END AS state
FROM states GROUP BY 1""")
def composite_alarm(t):
    return op.composite(_alarms(t), "period", "event_type", ["view", "purchase"], "ALARM(view) AND NOT ALARM(purchase)")


@query("E18", """WITH l AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_ts FROM events)
SELECT event_id, user_id, previous_ts, (epoch_us(ts) - epoch_us(previous_ts)) // 1000000 AS gap_s FROM l
WHERE epoch_us(ts) - epoch_us(previous_ts) > 43200000000""")
def logging_gaps(t):
    return op.gaps(t.events, ["user_id"], "ts", "event_id", 43200).select("event_id", "user_id", "previous_ts", "gap_s")


@query("E19", """WITH r AS (SELECT event_id % 4 AS part, event_id // 4 AS off, ts FROM events WHERE event_type <> 'error'),
l AS (SELECT *, lag(off) OVER (PARTITION BY part ORDER BY ts, off) AS previous_offset FROM r)
SELECT part, off, previous_offset, CASE WHEN off <= previous_offset THEN 'disorder' ELSE 'gap' END AS violation
FROM l WHERE off <> previous_offset + 1""")
def offset_violations(t):
    log = t.events.where(F.col("event_type") != "error").select(
        (F.col("event_id") % 4).alias("part"), F.floor(F.col("event_id") / 4).alias("off"), "ts")
    return op.order_violations(log, "part", "ts", "off").select("part", "off", "previous_offset", "violation")


@query("J30", sql(WEB) + """SELECT date_trunc('hour', ts) AS slot, count(*) AS n FROM web WHERE status = 404
GROUP BY 1 HAVING count(*) >= 3""")
def status_spikes(t):
    return op.spikes(web(t), 3600, 3, {"status": 404})
