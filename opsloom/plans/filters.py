"""Registered queries: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import filters as op
from opsloom.plans.registry import query
from opsloom.plans.roles import EV, FLOW, WEB, ev, flow, ntz_literal, sql, web

HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@query("B1", sql(FLOW) + "SELECT srcaddr, dstaddr, dstport FROM flow")
def project_columns(t):
    return op.project(flow(t), ["srcaddr", "dstaddr", "dstport"])


@query("B2", sql(EV) + "SELECT event_id, event_type AS kind, k AS first_tag FROM ev")
def project_nested_paths(t):
    nested = ev(t).select("event_id", F.struct(F.col("event_type").alias("kind"), F.array("k").alias("tags")).alias("item"))
    return op.project_paths(nested, {"event_id": "event_id", "kind": "item.kind", "first_tag": "item.tags[0]"})


@query("B3", sql(EV) + "SELECT event_id, user_id FROM ev WHERE value >= 50 AND event_type <> 'error'")
def compare_values(t):
    return op.where_cmp(op.where_cmp(ev(t), "value", ">=", 50), "event_type", "<>", "error").select("event_id", "user_id")


@query("B4 S2", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000")
def between_range(t):
    return op.where_between(t.orders, "o_totalprice", 1000, 90000).select("o_orderkey")


@query("B5", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def in_list(t):
    return op.where_in(t.events, "event_type", ["click", "purchase"]).select("event_id", "event_type")


@query("B6", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def begins_with(t):
    return op.where_prefix(t.customer, "c_name", "Customer#00000001").select("c_custkey", "c_name")


@query("B7", "SELECT p_partkey FROM part WHERE contains(p_name, 'ring')")
def contains_text(t):
    return op.where_contains(t.part, "p_name", "ring").select("p_partkey")


@query("B7", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def contains_member(t):
    words = t.part.withColumn("words", F.split("p_name", " "))
    return op.where_contains(words, "words", "ring").select("p_partkey")


@query("B8", "SELECT event_id FROM events WHERE event_type = 'error'")
def attribute_exists(t):
    # Only error rows carry the key; its value is null, which still exists.
    attrs = t.events.withColumn("attrs", F.when(F.col("event_type") == "error",
                                F.create_map(F.lit("reason"), F.lit(None).cast("string"))).otherwise(F.create_map()
                                .cast("map<string,string>")))
    return op.where_exists(attrs, "attrs", "reason").select("event_id")


@query("B8", "SELECT event_id FROM events WHERE NOT (event_type = 'error')")
def attribute_not_exists(t):
    attrs = t.events.withColumn("attrs", F.when(F.col("event_type") == "error",
                                F.create_map(F.lit("reason"), F.lit(None).cast("string"))).otherwise(F.create_map()
                                .cast("map<string,string>")))
    return op.where_exists(attrs, "attrs", "reason", exists=False).select("event_id")


@query("B9", "SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')")
def attribute_type(t):
    return op.where_type(t.events, "props", "$.k", "BIGINT").select("event_id")


@query("B10", "SELECT doc_id FROM documents WHERE length(text) > 500")
def attribute_size(t):
    return op.where_size(t.documents, "text", ">", 500).select("doc_id")


@query("B11", sql(EV) + """SELECT event_id FROM ev
WHERE (event_type = 'click' OR value > 80) AND NOT (k < 50)""")
def boolean_composition(t):
    return ev(t).where(((F.col("event_type") == "click") | (F.col("value") > 80)) & ~(F.col("k") < 50)).select("event_id")


@query("B12", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(red|blue) ')")
def like_regex(t):
    return op.where_like(t.part, "p_name", "^(red|blue) ").select("p_partkey")


@query("B12", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%widget%'")
def not_like(t):
    return op.where_like(t.part, "p_name", "widget", negate=True).select("p_partkey")


@query("B13", sql(WEB) + "SELECT event_id, status FROM web WHERE status BETWEEN 400 AND 599")
def status_class(t):
    return op.where_status(web(t), 400, 599).select("event_id", "status")


@query("B14", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def one_day(t):
    return op.where_day(t.events, "ts", "2024-01-15").select("event_id")


@query("B15", sql(FLOW) + "SELECT l_orderkey, l_linenumber FROM flow WHERE \"date\" >= DATE '2001-11-05' - 180")
def last_days(t):
    return op.where_last(flow(t), "date", 180, "2001-11-05").select("l_orderkey", "l_linenumber")


@query("B16", """WITH active AS (SELECT c_custkey, c_mktsegment, CAST(max(o_orderdate) AS DATE) AS last_active
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_mktsegment, count(*) AS churned FROM active WHERE last_active < DATE '2001-08-01' - 90 GROUP BY 1""")
def churned_by_segment(t):
    active = (t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("last_active"))
              .join(t.customer, F.col("o_custkey") == F.col("c_custkey")))
    return op.churned(active, "last_active", "c_mktsegment", "2001-08-01", 90)


@query("B17", sql(WEB) + r"""SELECT path, count(*) AS requests FROM web
WHERE NOT regexp_matches(path, '\.(css|js|png|jpg|svg|ico|woff)') GROUP BY 1""")
def non_static_urls(t):
    return op.exclude_static(web(t)).groupBy("path").agg(F.count(F.lit(1)).alias("requests"))


@query("B18", sql(WEB) + "SELECT client, count(*) AS requests FROM web WHERE agent ILIKE '%bot%' GROUP BY 1")
def bot_requests_by_client(t):
    return op.bots_by_ip(web(t))


@query("B19", sql(WEB) + """SELECT count(*) AS requests FROM web
WHERE agent = '-' OR regexp_matches(agent, 'curl|wget|python|scrapy')""")
def suspicious_agent_count(t):
    return op.suspicious_agents(web(t)).agg(F.count(F.lit(1)).alias("requests"))


@query("B20", sql(WEB) + "SELECT event_id, path FROM web WHERE path LIKE '%/admin%' OR path LIKE '%/.env%'")
def sensitive_path_requests(t):
    return op.sensitive_paths(web(t)).select("event_id", "path")


@query("B21", sql(WEB) + "SELECT event_id, CAST(rt AS DOUBLE) AS rt FROM web WHERE rt > 2")
def slow_request_rows(t):
    return op.slow_requests(web(t), 2.0).select("event_id", "rt")


@query("B21", sql(WEB) + "SELECT count(*) AS requests FROM web WHERE rt >= 2")
def two_seconds_or_more(t):
    return op.slow_requests(web(t), 2.0, inclusive=True).agg(F.count(F.lit(1)).alias("requests"))


def _labels(t):
    return t.events.select("event_id", F.map_concat(
        F.create_map(F.lit("type"), F.col("event_type")),
        F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("tier"), (F.col("user_id") % 3).cast("string")))
        .otherwise(F.create_map().cast("map<string,string>"))).alias("labels"))


@query("B22", """SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 2 = 0 AND user_id % 3 IN (0, 1)""")
def label_selector_in(t):
    return op.select_labels(_labels(t), "type=click,tier in (0, 1)").select("event_id")


@query("B22", """SELECT event_id FROM events WHERE event_type <> 'click' AND (user_id % 2 <> 0 OR user_id % 3 <> 2)""")
def label_selector_notin(t):
    return op.select_labels(_labels(t), "type!=click,tier notin (2)").select("event_id")


@query("B23", sql(EV) + """SELECT event_id FROM ev WHERE event_type IN ('view', 'purchase') AND value > 20 AND value <= 90""")
def filter_policy_columns(t):
    return op.match_policy(ev(t), {"event_type": ["view", "purchase"], "value": [{"numeric": [">", 20, "<=", 90]}]}
                           ).select("event_id")


@query("B23", """SELECT event_id FROM events WHERE starts_with(event_type, 'p') OR starts_with(event_type, 's')""")
def filter_policy_prefix(t):
    return op.match_policy(t.events, {"event_type": [{"prefix": "p"}, {"prefix": "s"}]}).select("event_id")


@query("B23", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view')")
def filter_policy_anything_but(t):
    return op.match_policy(t.events, {"event_type": [{"anything-but": ["error", "view"]}]}).select("event_id")


@query("B23", "SELECT event_id FROM events WHERE user_id % 2 = 0")
def filter_policy_exists(t):
    return op.match_policy(_labels(t), {"tier": [{"exists": True}]}, attributes="labels").select("event_id")


@query("B23", sql(EV) + "SELECT event_id FROM ev WHERE event_type = 'click' AND k > 50")
def event_pattern_nested(t):
    body = t.events.select("event_id", F.to_json(F.struct(
        F.lit("shop").alias("source"), F.struct("event_type", F.get_json_object("props", "$.k").alias("k")).alias("detail")
    )).alias("body"))
    pattern = {"source": ["shop"], "detail": {"event_type": ["click"], "k": [{"numeric": [">", 50]}]}}
    return op.match_policy(body, pattern, body="body").select("event_id")


@query("B24", "SELECT doc_id FROM documents WHERE contains(text, 'the') AND contains(text, 'an')")
def metric_filter_terms(t):
    return op.metric_filter(t.documents, "the an", "text").select("doc_id")


@query("B24", sql(EV) + "SELECT event_id FROM ev WHERE k >= 90")
def metric_filter_json(t):
    return op.metric_filter(t.events, "{ $.k >= 90 }", "props").select("event_id")


@query("B24", sql(WEB) + "SELECT event_id FROM web WHERE status = 500 AND method = 'GET'")
def metric_filter_fields(t):
    line = web(t).withColumn("message", F.concat_ws(" ", "client", "method", "path", F.col("status").cast("string")))
    return op.metric_filter(line, "[ip, method = GET, path, status = 500]").select("event_id")


@query("B25", f"SELECT event_id, user_id FROM events WHERE {HASH.format('CAST(user_id AS VARCHAR)')} % 100 < 10")
def sample_ten_percent(t):
    return op.sample_by_key(t.events, "user_id", 10).select("event_id", "user_id")


@query("B26", f"""SELECT c_custkey FROM customer
ORDER BY {HASH.format("CAST(c_custkey AS VARCHAR) || '/7'")}, c_custkey LIMIT 25""")
def random_members(t):
    return op.sample_n(t.customer, "c_custkey", 25, seed=7).select("c_custkey")


@query("B26", f"""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer
ORDER BY {HASH.format("CAST(c_custkey AS VARCHAR) || '/7'")}, c_custkey LIMIT 25)""")
def pop_random_members(t):
    return op.pop_rest(t.customer, "c_custkey", 25, seed=7).select("c_custkey")


@query("B27", r"""SELECT page_id, split_part(url, '?', 1) AS url FROM pages""")
def strip_query_strings(t):
    return op.redact(t.pages.select("page_id", "url"), {"url": "strip_query"})


@query("B27", r"""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'),
'[0-9]', 'n', 'g') AS c_name, sha256(c_mktsegment) AS c_mktsegment FROM customer""")
def mask_fields(t):
    return op.redact(t.customer.select("c_custkey", "c_name", "c_mktsegment"), {"c_name": "mask", "c_mktsegment": "hash"})


@query("B28", sql(WEB) + """SELECT event_id, ts, client, path FROM web WHERE status = 500 AND regexp_matches(path, '^/p/1')
ORDER BY ts DESC, event_id DESC LIMIT 50""")
def drilldown_newest(t):
    return op.drilldown(web(t), (F.col("status") == 500) & F.col("path").rlike("^/p/1"),
                        ["event_id", "ts", "client", "path"], "ts", "event_id", 50)


@query("B29", sql(EV) + """SELECT event_id FROM ev WHERE event_type = 'view' OR ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-31'""")
def live_rows(t):
    items = ev(t).withColumn("ttl", F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 10 DAY")))
    return op.live(items, "ttl", "2024-01-31").select("event_id")


@query("T7", f"""WITH numbered AS (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('second', ts)
  ORDER BY ts, event_id) AS rn FROM events)
SELECT event_id FROM numbered WHERE rn <= 1 OR {HASH.format('CAST(event_id AS VARCHAR)')} % 100 < 5""")
def reservoir_sampling(t):
    return op.reservoir_sample(t.events, "ts", "event_id", 1, 5).select("event_id")


@query("T7", f"""WITH numbered AS (SELECT o_orderkey, row_number() OVER (PARTITION BY date_trunc('second', o_orderdate)
  ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT o_orderkey FROM numbered WHERE rn <= 2 OR {HASH.format('CAST(o_orderkey AS VARCHAR)')} % 100 < 5""")
def reservoir_sampling_dense(t):
    return op.reservoir_sample(t.orders, "o_orderdate", "o_orderkey", 2, 5).select("o_orderkey")


@query("B3", """SELECT p_partkey, CASE WHEN p_retailprice > 950 THEN CASE WHEN p_size >= 10 THEN '' ELSE 'stock' END
  ELSE CASE WHEN p_size >= 10 THEN 'price' ELSE 'price,stock' END END AS failed_rules
FROM part WHERE NOT (p_retailprice > 950 AND p_size >= 10)""")
def rejected_records(t):
    _, rejected = op.valid_rows(t.part, {"price": F.col("p_retailprice") > 950, "stock": F.col("p_size") >= 10})
    return rejected.select("p_partkey", "failed_rules")


@query("H9", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-27'")
def week_bounds(t):
    end = ntz_literal("2024-01-27")
    return t.events.where((F.col("ts") >= end - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < end)).select("event_id")
