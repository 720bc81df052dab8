"""Registered queries: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions import hashing, scalars as fn
from opsloom.plans.filters import HASH
from opsloom.plans.registry import query
from opsloom.plans.roles import EV, WEB, ev, sql, web


@query("H1", "SELECT c_custkey, 'cart:user:' || c_custkey AS cart, c_mktsegment || '#' || c_nationkey AS pk FROM customer")
def composite_keys(t):
    return t.customer.select("c_custkey", fn.composite_key(F.lit("cart"), F.lit("user"), "c_custkey", separator=":").alias("cart"),
                             fn.composite_key("c_mktsegment", "c_nationkey").alias("pk"))


@query("H2", "SELECT doc_id, CAST(strlen(text) AS INT) AS bytes FROM documents")
def byte_lengths(t):
    return t.documents.select("doc_id", fn.strlen("text").alias("bytes"))


@query("H3", """SELECT c_custkey, substr(c_name, 1, 8) AS head, right(c_name, 4) AS tail, substr(c_name, 1, 9) || 'AB' || substr(c_name, 12) AS changed FROM customer""")
def string_ranges(t):
    return t.customer.select("c_custkey", fn.getrange("c_name", 0, 7).alias("head"), fn.getrange("c_name", -4, -1).alias("tail"),
                             fn.setrange("c_name", 9, "AB").alias("changed"))


@query("H4", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def lower_equality(t):
    return t.customer.where(F.lower("c_mktsegment") == "building").select("c_custkey")


@query("H5", sql(EV) + """SELECT event_id, CAST(value + k AS DOUBLE) AS added, CAST(value - k AS DOUBLE) AS subtracted, CAST(value * k AS DOUBLE) AS multiplied,
coalesce(CASE WHEN k % 7 <> 0 THEN CAST(value AS DOUBLE) / (k % 7) END, -1) AS divided, CASE WHEN k % 7 = 0 THEN 'division by zero' ELSE '' END AS error FROM ev""")
def calculator(t):
    quotient, error = fn.divide("value", F.col("k") % 7)
    return ev(t).select("event_id", (F.col("value") + F.col("k")).alias("added"), (F.col("value") - F.col("k")).alias("subtracted"),
                        (F.col("value") * F.col("k")).alias("multiplied"), F.coalesce(quotient, F.lit(-1.0)).alias("divided"), error.alias("error"))


@query("H6", sql(EV) + "SELECT user_id, CAST(sum(value) + 10.5 AS DOUBLE) AS total FROM ev GROUP BY 1")
def float_increments(t):
    return ev(t).groupBy("user_id").agg((F.sum("value") + F.lit("10.5").cast("decimal(4,1)")).alias("total"))


@query("H7", """SELECT c_custkey, round(c_acctbal / 7, 2) AS rounded, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer""")
def rounded_values(t):
    return t.customer.select("c_custkey", F.round(F.col("c_acctbal") / 7, 2).alias("rounded"),
                             F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("none")).alias("segment"))


@query("H10", """SELECT event_id, CASE WHEN user_id % 4 = 0 THEN '10.0.0.' || user_id WHEN user_id % 4 = 1 THEN '10.1.1.1'
WHEN user_id % 4 = 2 THEN '10.2.2.2' ELSE 'unknown' END AS ip FROM events""")
def client_addresses(t):
    kind = F.col("user_id") % 4
    headers = t.events.select("event_id", F.when(kind == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(", 172.16.0.1"))).otherwise("").alias("xff"),
                              F.when(kind == 1, "10.1.1.1").when(kind == 2, "").alias("real_ip"), F.when(kind <= 2, "10.2.2.2").alias("peer"))
    return headers.select("event_id", fn.client_ip("xff", "real_ip", "peer").alias("ip"))


def _instances(t):
    tag = lambda k, v: F.struct(F.lit(k).alias("Key"), v.alias("Value"))
    return t.orders.select("o_orderkey", F.array(F.struct(F.col("o_orderstatus").alias("State"), F.col("o_orderkey").alias("id")),
                           F.struct(F.lit("P").alias("State"), (F.col("o_orderkey") + 1).alias("id"))).alias("nodes"),
                           F.array(tag("Env", F.col("o_orderpriority")), tag("Team", F.col("o_orderstatus"))).alias("tags"))


@query("H11 H12 H13", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS matches,
CASE WHEN o_orderstatus = 'P' THEN o_orderkey ELSE o_orderkey + 1 END AS first_id, o_orderstatus || ',P' AS states
FROM orders WHERE o_orderpriority = '1-URGENT'""")
def array_expressions(t):
    rows = _instances(t).where(fn.has_tag("tags", "Env", "1-URGENT"))
    running = fn.array_where("nodes", "State", "P")
    return rows.select("o_orderkey", F.size(running).alias("matches"), F.get(running, F.lit(0))["id"].alias("first_id"),
                       F.array_join(fn.project_field("nodes", "State"), ",").alias("states"))


@query("H14", """SELECT c_custkey, c_mktsegment AS hget, c_name || '|' || '-' AS hmget, true AS hexists, 2 AS hlen, 'name' AS kept, 'name,segment,tier' AS added FROM customer""")
def hash_fields(t):
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    h = t.customer.select("c_custkey", m.alias("m"))
    return h.select("c_custkey", F.element_at("m", "segment").alias("hget"),
                    F.array_join(fn.hmget("m", ["name", "absent"]), "|", "-").alias("hmget"), F.map_contains_key("m", "name").alias("hexists"),
                    F.size("m").alias("hlen"), F.array_join(F.map_keys(fn.hdel("m", "segment")), ",").alias("kept"),
                    F.array_join(F.map_keys(fn.hset_if_absent(fn.hset_if_absent("m", "tier", F.lit("1")), "name", F.lit("x"))), ",").alias("added"))


@query("H15", sql(EV) + "SELECT event_id, CAST(k AS VARCHAR) AS k FROM ev")
def json_paths(t):
    return t.events.select("event_id", fn.json_get("props", "$.k").alias("k"))


@query("H16", sql(EV) + """SELECT event_id, '{"k":' || k || ',"detail":{"state":"done","by":"' || user_id || '"}}' AS doc FROM ev""")
def json_partial_update(t):
    doc = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"),
                             F.struct(F.lit("open").alias("state"), F.col("user_id").cast("string").alias("by")).alias("detail")))
    changed = fn.json_set(doc, "k int, detail struct<state: string, by: string>", {"detail.state": F.lit("done")})
    return t.events.select("event_id", changed.alias("doc"))


@query("H17 H24", """SELECT event_id, event_type AS event, CAST(user_id AS VARCHAR) AS "user", CASE WHEN user_id > 75 THEN 'true' ELSE 'false' END AS vip FROM events""")
def entry_data(t):
    entry = fn.string_fields({"order_id": F.col("event_id"), "event": F.col("event_type"), "user": F.col("user_id"), "vip": F.col("user_id") > 75})
    rows = t.events.select("event_id", "event_type", fn.data_map(entry, ["order_id", "event"]).alias("data"))
    return rows.select("event_id", F.col("event_type").alias("event"), F.col("data")["user"].alias("user"), F.col("data")["vip"].alias("vip"))


@query("H18 H19", f"""SELECT c_custkey, CAST({HASH.format('CAST(c_custkey AS VARCHAR)')} % 6 AS INT) AS part,
CAST({HASH.format('CAST(c_custkey AS VARCHAR)')} * 4 // 4294967296 AS INT) AS shard FROM customer""")
def key_placement(t):
    return t.customer.select("c_custkey", hashing.key_partition("c_custkey", 6).alias("part"), hashing.range_shard("c_custkey", 4).alias("shard"))


@query("H20", f"""SELECT event_id, event_type || '#' || {HASH.format('CAST(event_id AS VARCHAR)')} % 8 AS sharded, event_type AS base FROM events""")
def write_shards(t):
    keyed = t.events.withColumn("sharded", hashing.write_shard("event_type", "event_id", 8))
    return keyed.select("event_id", "sharded", hashing.base_key("sharded").alias("base"))


@query("H20", "SELECT event_type AS base, count(*) AS n FROM events GROUP BY 1")
def merged_write_shards(t):
    keyed = t.events.withColumn("sharded", hashing.write_shard("event_type", "event_id", 8))
    per_shard = keyed.groupBy("sharded").agg(F.count(F.lit(1)).alias("n"))
    return per_shard.groupBy(hashing.base_key("sharded").alias("base")).agg(F.sum("n").alias("n"))


@query("H21", "SELECT event_id, 'DEVICE#' || user_id || '#' || strftime(ts, '%Y-%m-%d') AS pk FROM events")
def time_bucketed_keys(t):
    return t.events.select("event_id", fn.time_key("user_id", "ts").alias("pk"))


@query("H23", """SELECT c_custkey, n, 'Hello ' || c_name || ' ' || n AS reply FROM customer, (SELECT unnest([1, 2, 3]) AS n)""")
def numbered_greetings(t):
    return fn.greetings(t.customer.withColumn("word", F.lit("Hello")), "word", "c_name").select("c_custkey", "n", "reply")


@query("H23", "SELECT c_custkey, 'Hello ' || c_name AS reply FROM customer")
def greeting(t):
    return t.customer.select("c_custkey", fn.greeting(F.lit("Hello"), "c_name").alias("reply"))


@query("H25", r"""SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host,
coalesce(nullif(regexp_extract(url, '\?([^#]*)', 1), ''), '-') AS query FROM pages""")
def url_parts(t):
    parts = fn.url_parts("url")
    return t.pages.select("page_id", parts["scheme"].alias("scheme"), parts["host"].alias("host"), F.coalesce(parts["query"], F.lit("-")).alias("query"))


@query("H8", sql(WEB) + "SELECT date_trunc('day', ts) AS slot, edge, count(*) AS n FROM web GROUP BY 1, 2")
def requests_per_day_and_edge(t):
    from opsloom.functions.timeutil import floor_time
    return web(t).groupBy(floor_time("ts", "day").alias("slot"), "edge").agg(F.count(F.lit(1)).alias("n"))
