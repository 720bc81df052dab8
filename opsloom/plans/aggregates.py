"""Registered queries: log and business aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import aggregates as op
from opsloom.plans.registry import query
from opsloom.plans.roles import EV, FLOW, PRODUCTS, WEB, ev, flow, products, sql, web

AS_OF = "2001-11-05"


@query("D1", "SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def count_errors(t):
    return op.count_rows(t.events.where(F.col("event_type") == "error"))


@query("D2", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_type(t):
    return op.count_by(t.events, "event_type")


@query("D3", sql(WEB) + "SELECT status, count(*) AS requests FROM web GROUP BY 1")
def status_distribution(t):
    return op.status_distribution(web(t))


@query("D4", sql(WEB) + "SELECT client, status, count(*) AS n FROM web GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100")
def count_by_client_status(t):
    return op.count_by2(web(t), "client", "status", 100)


@query("D4", sql(WEB) + "SELECT edge, status, count(*) AS n FROM web GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50")
def count_by_edge_status(t):
    return op.count_by2(web(t), "edge", "status", 50)


@query("D5", sql(WEB) + """SELECT path, count(*) AS failures FROM web WHERE status BETWEEN 400 AND 599
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def top_failing_urls(t):
    return op.top_failures(web(t), 400, 599, 50)


@query("D5", sql(WEB) + """SELECT path, count(*) AS failures FROM web WHERE status = 404
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def top_not_found(t):
    return op.top_failures(web(t), 404, 404, 20)


@query("D6", sql(WEB) + """SELECT path, status, cache, count(*) AS requests FROM web WHERE status BETWEEN 500 AND 599
GROUP BY 1, 2, 3""")
def incident_breakdown(t):
    return op.incident_breakdown(web(t))


@query("D7", sql(WEB) + "SELECT client, count(*) AS n FROM web GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_clients(t):
    return op.top_k_by_count(web(t), "client", 20)


@query("D7", sql(WEB) + "SELECT agent, count(*) AS n FROM web GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_user_agents(t):
    return op.top_k_by_count(web(t), "agent", 50)


@query("D7", sql(WEB) + "SELECT path, count(*) AS n FROM web GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_urls(t):
    return op.top_k_by_count(web(t), "path", 20)


@query("D8 A1 B15", sql(FLOW) + """SELECT srcaddr, CAST(sum(bytes) AS BIGINT) AS total_bytes,
CAST(sum(packets) AS BIGINT) AS total_packets FROM flow WHERE "date" >= DATE '2001-11-05' - 700
GROUP BY 1 ORDER BY sum(bytes) DESC, 1 LIMIT 20""")
def top_talkers(t):
    return op.top_talkers(flow(t), AS_OF, 700, 20)


@query("D9", sql(FLOW) + """SELECT dstaddr, CAST(sum(bytes) AS BIGINT) AS total_bytes,
CAST(sum(packets) AS BIGINT) AS total_packets FROM flow WHERE "date" >= DATE '2001-11-05' - 700
GROUP BY 1 ORDER BY sum(bytes) DESC, 1 LIMIT 20""")
def top_destinations(t):
    return op.top_destinations(flow(t), AS_OF, 700, 20)


@query("D10", sql(FLOW) + """SELECT dstport, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS flow_count
FROM flow GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 30""")
def top_ports(t):
    return op.top_ports(flow(t))


@query("D10", sql(FLOW) + """SELECT dstport, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS flow_count
FROM flow WHERE action = 'ACCEPT' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 30""")
def top_accepted_ports(t):
    return op.top_ports(flow(t), accepted_only=True)


@query("D11", sql(FLOW) + """SELECT srcaddr, dstaddr, dstport, protocol, CAST(sum(packets) AS BIGINT) AS packets,
CAST(sum(bytes) AS BIGINT) AS bytes FROM flow WHERE action = 'REJECT' GROUP BY 1, 2, 3, 4""")
def rejected_traffic(t):
    return op.rejected_traffic(flow(t))


@query("D12", sql(FLOW) + """SELECT srcaddr, dstaddr, dstport, count(*) AS rejected FROM flow
WHERE action = 'REJECT' AND "date" >= DATE '2001-11-05' - 700 GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 100""")
def rejected_counts(t):
    return op.rejected_counts(flow(t), AS_OF, 700, 100)


@query("D13", sql(FLOW) + """SELECT srcaddr, dstaddr, CAST(sum(packets) AS BIGINT) AS packets, count(*) AS attempts
FROM flow WHERE action = 'REJECT' AND dstport = 5 AND protocol = 'O' GROUP BY 1, 2""")
def rejected_to_port(t):
    return op.rejected_to_port(flow(t), 5, "O")


@query("D14", sql(FLOW) + """SELECT srcaddr, count(*) AS rejected FROM flow WHERE action = 'REJECT'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def rejects_by_source(t):
    return op.rejects_by(flow(t), "srcaddr")


@query("D14", sql(FLOW) + """SELECT dstport, count(*) AS rejected FROM flow WHERE action = 'REJECT'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def rejects_by_port(t):
    return op.rejects_by(flow(t), "dstport")


@query("D15", sql(FLOW) + """SELECT dstaddr, dstport, count(*) AS rejected FROM flow WHERE action = 'REJECT'
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50""")
def most_rejected(t):
    return op.most_rejected(flow(t))


@query("D16", sql(FLOW) + """SELECT srcaddr, dstaddr, dstport, protocol, action, CAST(sum(packets) AS BIGINT) AS packets,
CAST(sum(bytes) AS BIGINT) AS bytes FROM flow WHERE dstport = 3 AND protocol = 'F' GROUP BY 1, 2, 3, 4, 5""")
def port_breakdown(t):
    return op.port_breakdown(flow(t), 3, "F")


@query("D17", sql(FLOW) + """SELECT account_id, region, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS flows
FROM flow GROUP BY 1, 2""")
def traffic_by_account_region(t):
    return op.traffic_by(flow(t), "account_id", "region")


@query("D17", sql(FLOW) + "SELECT vpc_id, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS flows FROM flow GROUP BY 1")
def traffic_by_network(t):
    return op.traffic_by(flow(t), "vpc_id")


@query("D17", sql(FLOW) + "SELECT subnet_id, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS flows FROM flow GROUP BY 1")
def traffic_by_subnet(t):
    return op.traffic_by(flow(t), "subnet_id")


@query("D18", sql(FLOW) + "SELECT protocol, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS flows FROM flow GROUP BY 1")
def traffic_by_protocol(t):
    return op.traffic_by(flow(t), "protocol")


@query("D19", sql(FLOW) + """SELECT interface_id, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM flow
GROUP BY 1 ORDER BY sum(bytes) DESC, 1 LIMIT 20""")
def top_interfaces(t):
    return op.top_interfaces(flow(t))


@query("D20", sql(FLOW) + """SELECT srcaddr, dstaddr, dstport, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM flow
WHERE "date" >= DATE '1998-08-01' AND "date" < DATE '1998-09-01' GROUP BY 1, 2, 3""")
def flow_matrix(t):
    return op.flow_matrix(flow(t), "1998-08-01", "1998-09-01")


@query("D21", sql(WEB) + """SELECT path, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS requests FROM web
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def large_responses(t):
    return op.large_responses(web(t))


@query("D22", sql(FLOW) + "SELECT round(CAST(sum(bytes) AS DOUBLE) / 1073741824, 2) AS gb FROM flow")
def bandwidth_total(t):
    return op.bandwidth_gb(flow(t))


@query("D22", sql(WEB) + """SELECT path, round(CAST(sum(bytes) AS DOUBLE) / 1048576, 2) AS mb FROM web
GROUP BY 1 ORDER BY sum(bytes) DESC, 1 LIMIT 20""")
def bandwidth_per_url(t):
    return op.bandwidth_by_url(web(t))


@query("D23", """SELECT r_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1""")
def revenue_by_region(t):
    dated = t.orders.where(F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"),
                                                        F.lit("1997-12-31").cast("timestamp_ntz")))
    # Revenue is summed per customer first: the dimension joins then see one row per customer.
    per_customer = dated.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))
    return (per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy("r_name").agg(F.sum("amount").cast("double").alias("revenue")))


@query("D24 C1", """SELECT p_type, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_amount,
count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def category_performance(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    joined = lines.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return op.category_performance(joined, "p_type", "amount", "l_orderkey").orderBy(F.desc("avg_amount"))


@query("D25", sql(PRODUCTS) + "SELECT category, count(*) AS n FROM products GROUP BY 1")
def products_by_category(t):
    return op.count_by(products(t), "category")


@query("D25", sql(PRODUCTS) + "SELECT CAST(coalesce(sum(price * stock), 0) AS DOUBLE) AS total_value FROM products")
def inventory_value(t):
    return op.inventory_value(products(t))


CART = """lines AS (SELECT user_id, k AS product_id, CAST(sum(1) AS BIGINT) AS quantity FROM ev
  WHERE event_type = 'purchase' GROUP BY 1, 2)"""


def cart_lines(t):
    bought = ev(t).where(F.col("event_type") == "purchase").withColumnRenamed("k", "product_id")
    return op.cart_state(bought.withColumn("one", F.lit(1).cast("bigint")), ["user_id", "product_id"], "one", ["ts"])


@query("D26 C6", sql(EV, PRODUCTS, CART) + """SELECT user_id, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS items,
CAST(round(sum(price * quantity), 2) AS DOUBLE) AS total FROM lines JOIN products ON id = product_id AND id < 90 GROUP BY 1""")
def cart_totals(t):
    # Products from 90 up are gone: their cart lines drop out.
    priced = cart_lines(t).join(products(t).where("id < 90").withColumnRenamed("id", "product_id"), "product_id")
    return op.cart_totals(priced)


@query("D27", sql(EV) + """SELECT user_id, event_type, CAST(sum(k) AS BIGINT) AS quantity FROM ev GROUP BY 1, 2""")
def cart_accumulate(t):
    return op.cart_state(ev(t), ["user_id", "event_type"], "k", ["ts", "event_id"], "add")


@query("D27", sql(EV) + "SELECT user_id, event_type, arg_max(k, event_id) AS quantity FROM ev GROUP BY 1, 2")
def cart_overwrite(t):
    return op.cart_state(ev(t), ["user_id", "event_type"], "k", ["ts", "event_id"], "overwrite")


@query("D28", """SELECT user_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS BIGINT) AS value
FROM events GROUP BY 1""")
def view_counters(t):
    delta = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return op.counters(t.events, ["user_id"], delta)


@query("D34", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def orders_per_customer(t):
    return op.count_by(t.orders, "o_custkey")


@query("D37", sql(WEB) + "SELECT round(CAST(sum(rt) AS DOUBLE) / count(rt), 3) AS seconds FROM web")
def avg_response_time(t):
    return op.avg_response_time(web(t))


@query("D40", sql(WEB) + "SELECT cache, count(*) AS n FROM web GROUP BY 1")
def cache_distribution(t):
    return op.count_by(web(t), "cache")


@query("D44", sql(WEB) + """SELECT date_trunc('hour', ts) AS slot, client, count(*) AS requests,
count(*) FILTER (status BETWEEN 400 AND 499) AS client_errors, count(DISTINCT path) AS paths, count(*) / 3600.0::DOUBLE AS rate
FROM web GROUP BY 1, 2""")
def ip_profile(t):
    return op.ip_profile(web(t), 3600)


@query("D45", """SELECT user_id, count(*) AS n, count(*) / (SELECT count(*) FROM events) AS share
FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def contributor_report(t):
    return op.contributors(t.events, "user_id", 10)


@query("D47", """SELECT event_type, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_time,
round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS mean_time FROM events GROUP BY 1
ORDER BY 4 DESC, 1 LIMIT 10""")
def slow_statements(t):
    return op.slow_statements(ev(t), "event_type", "value")


@query("D48", """WITH s AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS dead, count(*) FILTER (l_returnflag <> 'R') AS live
FROM lineitem GROUP BY 1)
SELECT l_suppkey, dead, live, round(dead * 100.0::DOUBLE / nullif(dead + live, 0), 2) AS dead_pct FROM s WHERE dead > 10
ORDER BY dead DESC, l_suppkey LIMIT 20""")
def dead_row_share(t):
    stats = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("dead"),
                                                F.count_if(F.col("l_returnflag") != "R").alias("live"))
    return op.dead_pct(stats, "dead", "live", 10, 20)


@query("D49", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 40")
def connections_by_state(t):
    return op.count_by2(t.events, "user_id", "event_type", 40)


@query("D50", """WITH m AS (SELECT CASE event_type WHEN 'error' THEN 'crit' WHEN 'signup' THEN 'notice' ELSE 'warn' END AS severity
FROM events) SELECT severity, count(*) AS n FROM m WHERE severity IN ('emerg', 'alert', 'crit', 'error', 'warn') GROUP BY 1""")
def errors_by_severity(t):
    level = F.when(F.col("event_type") == "error", "crit").when(F.col("event_type") == "signup", "notice").otherwise("warn")
    lines = t.events.select(F.format_string("[%s] request %d", level, F.col("event_id")).alias("message"))
    return op.errors_by_severity(lines)


@query("D51", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
FROM orders) SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS latest FROM r WHERE rn <= 5 GROUP BY 1""")
def latest_orders_nested(t):
    nested = op.latest_n_nested(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", ["o_orderkey"], 5)
    return nested.select("o_custkey", F.array_join(F.transform("latest", lambda s: s["o_orderkey"].cast("string")), ",").alias("latest"))


@query("D52", """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, n, n / (SELECT sum(n) FROM c) AS share, n / ((SELECT sum(n) FROM c) / (SELECT count(*) FROM c)) AS times_mean
FROM c ORDER BY n DESC, 1 LIMIT 20""")
def hot_keys(t):
    return op.skew_report(t.lineitem, "l_partkey", 20)


@query("D53", """WITH s AS (SELECT date_trunc('hour', ts) AS slot, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 3600 AS rate
FROM events GROUP BY 1) SELECT max(rate) AS peak, round(sum(rate) / count(*), 6) AS average,
CAST(ceil(max(rate) / 2.5::DOUBLE) AS BIGINT) AS partitions FROM s""")
def capacity_plan(t):
    return op.capacity(web(t), 3600, "bytes", 2.5)


@query("D56", """SELECT lang, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes,
arg_max(doc_id, strlen(text) * 1000000000 + doc_id) AS largest FROM documents GROUP BY 1""")
def big_values_by_type(t):
    return op.big_values(t.documents, "lang", "doc_id", "text")


@query("D57", sql(WEB) + "SELECT path, CAST(ts AS DATE) AS day, count(*) AS views FROM web GROUP BY 1, 2")
def page_views_per_day(t):
    return op.page_views(web(t), "path")


@query("D58", """SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) // 1000000 AS age_s
FROM events WHERE event_type <> 'view'""")
def long_running_statements(t):
    calls = t.events.withColumn("state", F.when(F.col("event_type") == "view", "idle").otherwise("active"))
    return op.long_running(calls, "ts", "state", "2024-01-31").select("event_id", "age_s")


@query("D59", """WITH u AS (SELECT p_partkey, p_name, p_size, count(l_partkey) FILTER (l_quantity > 49) AS scans FROM part
LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3)
SELECT p_partkey, p_size FROM u WHERE scans = 0 AND p_name NOT LIKE '%ring%'""")
def never_used(t):
    used = t.lineitem.where("l_quantity > 49").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("scans"))
    counted = t.part.join(used, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("scans", F.coalesce("scans", F.lit(0)))
    return op.unused(counted, "scans", "p_name", "ring", "p_size").select("p_partkey", "p_size")


@query("D61", """WITH c AS (SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost, count(*) AS n,
count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT event_type, cost * 1000 / n AS per_1000, cost / users AS per_user FROM c""")
def unit_costs(t):
    return op.unit_cost(ev(t).withColumnRenamed("value", "cost"), t.events, "event_type", "user_id")


@query("H8 D1", "SELECT date_trunc('minute', ts) AS slot, count(*) AS requests FROM events GROUP BY 1")
def requests_per_minute(t):
    return op.requests_per(t.events, "minute")


@query("H8", "SELECT date_trunc('hour', ts) AS slot, count(*) AS requests FROM events GROUP BY 1")
def requests_per_hour(t):
    return op.requests_per(t.events, "hour")


@query("H8", "SELECT date_trunc('second', ts) AS slot, count(*) AS requests FROM events GROUP BY 1")
def requests_per_second(t):
    return op.requests_per(t.events, "second")
