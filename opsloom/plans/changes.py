"""Registered queries: table changes, keyed logs, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.timeutil import time_chunk
from opsloom.operators import changes as op, limits
from opsloom.plans.joins import SUMMARY, product_summary
from opsloom.plans.registry import query
from opsloom.plans.roles import EV, VERSIONS, ev, sql, versions
from opsloom.session import work_path


@query("I1", "SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey + 1000000 FROM supplier")
def insert_rows(t):
    return op.insert(t.customer.select("c_custkey"), t.supplier.select((F.col("s_suppkey") + 1000000).alias("c_custkey")))


@query("I2", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment,
CASE WHEN c_acctbal > 5000 THEN 'renamed' ELSE c_name END AS c_name,
CASE WHEN c_acctbal > 5000 OR c_mktsegment = 'BUILDING' THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM customer""")
def partial_update(t):
    base = t.customer.select("c_custkey", "c_mktsegment", "c_name", F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    none = F.create_map().cast("map<string,string>")
    named = F.when(F.col("c_acctbal") > 5000, F.create_map(F.lit("c_name"), F.lit("renamed"))).otherwise(none)
    cleared = F.when(F.col("c_mktsegment") == "BUILDING", F.create_map(F.lit("c_mktsegment"), F.lit(None).cast("string"))).otherwise(none)
    patches = t.customer.where("c_acctbal > 5000 OR c_mktsegment = 'BUILDING'").select(
        "c_custkey", F.map_concat(named, cleared).alias("fields"), F.lit("2024-02-01").cast("timestamp_ntz").alias("updated_at"))
    return op.patch(base, patches, "c_custkey", "updated_at")


@query("I3", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_by_key(t):
    gone = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return op.delete(t.orders, gone, "o_custkey").select("o_orderkey")


@query("I4", """SELECT p_partkey, CASE WHEN p_size > 40 THEN 99 ELSE p_size END AS p_size FROM part
UNION ALL SELECT p_partkey + 10000000, 99 FROM part WHERE p_size > 40""")
def upsert_rows(t):
    changed = t.part.where("p_size > 40").select("p_partkey", F.lit(99).alias("p_size"))
    fresh = changed.withColumn("p_partkey", F.col("p_partkey") + 10000000)
    return op.upsert(t.part.select("p_partkey", "p_size"), changed.union(fresh), "p_partkey")


@query("I5", """WITH b AS (SELECT o_custkey AS c_custkey, o_orderpriority AS c_mktsegment, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, c_mktsegment FROM b WHERE rn = 1
AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def put_if_absent(t):
    base = t.customer.where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    rows = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    return op.put_if_absent(base, rows, "c_custkey", ["o_orderkey"])


@query("I6", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, n <= p_size AS accepted FROM r JOIN part ON p_partkey = l_partkey""")
def decrement_stock(t):
    requests = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    stock = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return op.decrement_if(stock, requests, "l_partkey", "p_size", ["l_shipdate", "l_orderkey", "l_linenumber"],
                           time_chunk("l_shipdate", 86400 * 90)).select("l_orderkey", "l_linenumber", "accepted")


@query("I6", """WITH RECURSIVE r AS (SELECT l_partkey AS part, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) AS n,
  l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS BIGINT) AS want, coalesce(p_size * 5, 0) AS stock FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5),
f AS (SELECT part, n, id, want <= stock AS accepted, CASE WHEN want <= stock THEN stock - want ELSE stock END AS stock FROM r WHERE n = 1
  UNION ALL SELECT r.part, r.n, r.id, r.want <= f.stock, CASE WHEN r.want <= f.stock THEN f.stock - r.want ELSE f.stock END
  FROM f JOIN r ON r.part = f.part AND r.n = f.n + 1)
SELECT id, accepted FROM f""")
def decrement_stock_sized(t):
    requests = t.lineitem.select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_shipdate", "l_quantity")
    stock = t.part.where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 5).alias("stock"))
    return limits.decrement_by(stock, requests, "l_partkey", "stock", "l_quantity", "l_shipdate", "id").select("id", F.col("allowed").alias("accepted"))


WRITES = """writes AS (SELECT o_custkey AS k, o_orderkey AS wid, o_orderkey % 3 AS version, o_orderpriority AS value FROM orders),
cur AS (SELECT c_custkey AS k, c_custkey % 2 AS version, c_mktsegment AS value FROM customer),
win AS (SELECT w.k, min(wid) AS wid, arg_min(w.value, wid) AS value FROM writes w JOIN cur c ON w.k = c.k AND w.version = c.version GROUP BY 1)"""


def _versioned(t):
    writes = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("wid"),
                             (F.col("o_orderkey") % 3).alias("version"), F.col("o_orderpriority").alias("value"))
    current = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 2).alias("version"), F.col("c_mktsegment").alias("value"))
    return op.apply_versioned(current, writes, "k", "version", "value", ["wid"])


@query("I7", sql(WRITES) + """SELECT c.k, CASE WHEN w.k IS NULL THEN c.version ELSE c.version + 1 END AS version,
CASE WHEN w.k IS NULL THEN c.value ELSE w.value END AS value FROM cur c LEFT JOIN win w ON c.k = w.k""")
def versioned_writes(t):
    return _versioned(t)[0]


@query("I7", sql(WRITES) + "SELECT k, wid FROM writes WHERE wid NOT IN (SELECT wid FROM win)")
def stale_writes(t):
    return _versioned(t)[1].select("k", "wid")


BATCH = """ops AS (SELECT event_id, CASE WHEN k % 11 = 0 THEN NULL ELSE user_id * 100 + k END AS item, event_type,
  CASE event_type WHEN 'view' THEN 'put' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'put' ELSE 'scan' END AS op FROM ev),
ok AS (SELECT item, min(event_id) AS event_id FROM ops WHERE op IN ('put', 'delete') AND item IS NOT NULL GROUP BY 1),
base AS (SELECT c_custkey * 10 AS item, c_mktsegment AS event_type FROM customer)"""


def _batch(t):
    verb = F.when(F.col("event_type").isin("view", "click"), "put").when(F.col("event_type") == "error", "delete").otherwise("scan")
    ops = ev(t).select("event_id", F.when(F.col("k") % 11 != 0, F.col("user_id") * 100 + F.col("k")).alias("item"), "event_type", verb.alias("op"))
    base = t.customer.select((F.col("c_custkey") * 10).alias("item"), F.col("c_mktsegment").alias("event_type"))
    return op.apply_batch(base, ops, "item", "op", ["event_id"])


@query("I8", sql(EV, BATCH) + """SELECT item, event_type FROM base WHERE item NOT IN (SELECT item FROM ok)
UNION ALL SELECT ok.item, event_type FROM ok JOIN ops USING (event_id) WHERE op = 'put'""")
def batch_write(t):
    return _batch(t)[0]


@query("I8", sql(EV, BATCH) + "SELECT event_id FROM ops WHERE event_id NOT IN (SELECT event_id FROM ok)")
def batch_unprocessed(t):
    return _batch(t)[1].select("event_id")


@query("I9", """SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'unknown product'
WHEN p_size < l_quantity THEN 'not enough in stock' ELSE '' END AS error FROM lineitem
LEFT JOIN (SELECT * FROM part WHERE p_brand <> 'Brand#3') ON p_partkey = l_partkey""")
def validate_cart(t):
    requests = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    known = t.part.where("p_brand <> 'Brand#3'").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return op.validate_cart(requests, known, "l_partkey", "l_quantity", "p_size").select("l_orderkey", "l_linenumber", "error")


LAST = """last AS (SELECT k, seq, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM versions) WHERE rn = 1)"""


@query("I10", sql(VERSIONS, LAST) + "SELECT k, seq, value FROM last WHERE value IS NOT NULL")
def compacted_log(t):
    return op.compact(versions(t), "k", "seq", "value").select("k", "seq", "value")


@query("I11", sql(VERSIONS, LAST) + "SELECT k, seq FROM last WHERE value IS NOT NULL AND ts >= TIMESTAMP '2001-08-01' - INTERVAL 730 DAY")
def compacted_and_retained(t):
    return op.compact_and_delete(versions(t), "k", "seq", "value", "ts", "2001-08-01", 730 * 86400).select("k", "seq")


@query("I12", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def retain_by_age(t):
    return op.retain_age(t.events, "ts", "2024-01-31", 7 * 86400).select("event_id")


@query("I12", """SELECT event_id FROM (SELECT event_id, sum(strlen(props) + strlen(event_type)) OVER (PARTITION BY event_type ORDER BY event_id DESC) AS b
FROM events) WHERE b <= 20000""")
def retain_by_bytes(t):
    size = (F.octet_length("props") + F.octet_length("event_type")).cast("bigint")
    return op.retain_bytes(t.events, "event_type", "event_id", size, 20000, 1000).select("event_id")


@query("I13", """SELECT event_id, CAST(CASE WHEN event_type = 'view' THEN -1 WHEN ts + INTERVAL 10 DAY <= TIMESTAMP '2024-01-31' THEN -2
ELSE (epoch_us(ts + INTERVAL 10 DAY) - epoch_us(TIMESTAMP '2024-01-31')) // 1000000 END AS BIGINT) AS ttl FROM events""")
def remaining_ttl(t):
    items = t.events.withColumn("expires", F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 10 DAY")))
    return op.ttl_seconds(items, "expires", "2024-01-31").select("event_id", "ttl")


@query("I14", "SELECT c_custkey FROM customer WHERE c_name NOT LIKE 'Customer#%7'")
def delete_by_glob(t):
    return op.delete_matching(t.customer, "c_name", "Customer#*7").select("c_custkey")


@query("I15", """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1
HAVING max(o_orderdate) >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY)""")
def expire_abandoned(t):
    return op.expire_carts(t.orders, "o_custkey", "o_orderdate", "2001-08-01", 180).select("o_orderkey")


@query("I16", """WITH c AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS seg, arg_max(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY 1)
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM c)
UNION ALL SELECT o_custkey, seg FROM c WHERE st <> 'F'""")
def apply_change_stream(t):
    changes = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey",
                              F.when(F.col("o_orderstatus") == "F", "REMOVE").otherwise("MODIFY").alias("op"))
    return op.apply_changes(t.customer.select("c_custkey", "c_mktsegment"), changes, "c_custkey", "o_orderkey", "op")


@query("I17", """SELECT o_orderkey, 'status' AS field, o_orderstatus AS "old", 'F' AS "new" FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT o_orderkey, 'note', NULL, 'closed' FROM orders""")
def change_diff(t):
    image = lambda status: F.create_map(F.lit("status"), status, F.lit("priority"), F.col("o_orderpriority"))
    closed = F.map_concat(image(F.lit("F")), F.create_map(F.lit("note"), F.lit("closed")))
    changes = t.orders.select("o_orderkey", image(F.col("o_orderstatus")).alias("before"), closed.alias("after"))
    return op.diff(changes, ["o_orderkey"], "before", "after")


@query("I18", sql(VERSIONS) + "SELECT k, value FROM versions WHERE value IS NOT NULL")
def index_keys_only(t):
    return op.index_view(versions(t), ["value", "k"], "KEYS_ONLY")


@query("I18", sql(VERSIONS) + "SELECT k, value, ts FROM versions WHERE value IS NOT NULL")
def index_include(t):
    return op.index_view(versions(t), ["value", "k"], "INCLUDE", ["ts"])


@query("I18", sql(VERSIONS) + "SELECT k, value, ts, seq FROM versions WHERE value IS NOT NULL")
def index_all(t):
    return op.index_view(versions(t), ["value", "k"], "ALL")


@query("I19", SUMMARY)
def refreshed_summary(t):
    return op.refresh(product_summary(t), work_path(t.spark, "summary"))


OBJECTS = """objects AS (SELECT o_orderkey AS oid, o_orderpriority || '/' || o_orderkey AS key, o_orderstatus AS tag,
  CAST(o_totalprice AS BIGINT) AS size, o_orderdate AS modified, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age FROM orders)"""


@query("I20", sql(OBJECTS) + """SELECT oid, CASE WHEN starts_with(key, '5-LOW') AND age >= 1500 THEN 'expire'
WHEN starts_with(key, '5-LOW') AND age >= 700 THEN 'transition:COLD' WHEN tag = 'F' AND size >= 100000 AND age >= 365 THEN 'transition:ARCHIVE'
WHEN starts_with(key, '5-LOW') AND age >= 90 THEN 'transition:WARM' ELSE 'keep' END AS action FROM objects""")
def lifecycle_plan(t):
    objects = t.orders.select(F.col("o_orderkey").alias("oid"), F.concat_ws("/", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("key"),
                              F.col("o_orderstatus").alias("tag"), F.floor("o_totalprice").alias("size"), F.col("o_orderdate").alias("modified"))
    rules = [{"prefix": "5-LOW", "transitions": [(90, "WARM"), (700, "COLD")], "expire_days": 1500},
             {"tag": "F", "min_size": 100000, "transitions": [(365, "ARCHIVE")]}]
    return op.lifecycle_plan(objects, rules, "2001-08-01").select("oid", "action")


@query("I20", """SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 4""")
def noncurrent_versions(t):
    return op.noncurrent_cleanup(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", 3).select("o_orderkey")


@query("E20", """SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS allowed FROM events""")
def rate_fixed_window(t):
    return limits.rate_fixed(t.events, "user_id", "ts", "event_id", 2, 86400).select("event_id", "allowed")


ANCHORS = """a AS (SELECT user_id, min(ts) AS anchor FROM events GROUP BY 1
  UNION ALL SELECT user_id, nxt FROM (SELECT a.user_id, (SELECT min(ts) FROM events e WHERE e.user_id = a.user_id AND e.ts >= a.anchor + INTERVAL 1 DAY) AS nxt FROM a) WHERE nxt IS NOT NULL)"""


@query("E21", sql(ANCHORS, recursive=True) + """SELECT event_id, row_number() OVER (PARTITION BY e.user_id, anchor ORDER BY e.ts, event_id) <= 2 AS allowed
FROM events e ASOF JOIN a ON e.user_id = a.user_id AND e.ts >= a.anchor""")
def rate_anchored_window(t):
    return limits.rate_anchored(t.events, "user_id", "ts", "event_id", 2, 86400).select("event_id", "allowed")


@query("E22", """SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 3 AS over FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def rate_sliding_count(t):
    return limits.rate_sliding_flag(t.events, "user_id", "ts", 3, 86400).select("event_id", "in_window", "over")


NUMBERED = """n AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""


@query("E22", sql(NUMBERED, """f AS (SELECT user_id, event_id, i, true AS allowed, [us] AS held FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.event_id, n.i, len(list_filter(held, lambda x: x > n.us - 86400000000)) < 2,
  CASE WHEN len(list_filter(held, lambda x: x > n.us - 86400000000)) < 2 THEN list_append(list_filter(held, lambda x: x > n.us - 86400000000), n.us)
  ELSE list_filter(held, lambda x: x > n.us - 86400000000) END FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)""", recursive=True) +
       "SELECT event_id, allowed FROM f")
def rate_sliding_log(t):
    return limits.rate_sliding(t.events, "user_id", "ts", "event_id", 2, 86400).select("event_id", "allowed")


@query("E23", """WITH b AS (SELECT user_id, epoch_us(ts) // 8640000000 AS b, count(*) AS requests FROM events GROUP BY 1, 2),
w AS (SELECT *, CAST(sum(requests) OVER (PARTITION BY user_id ORDER BY b RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM b)
SELECT user_id, make_timestamp(b * 8640000000) AS slot, requests, in_window, in_window > 3 AS over FROM w""")
def rate_bucket_counter(t):
    return limits.rate_buckets(t.events, "user_id", "ts", 3, 86400, 10)


@query("E24", sql(NUMBERED, """f AS (SELECT user_id, event_id, i, us, true AS allowed, CAST(3 AS BIGINT) * 43200000000 - 43200000000 AS credit FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.event_id, n.i, n.us, least(129600000000, credit + n.us - f.us) >= 43200000000,
  least(129600000000, credit + n.us - f.us) - CASE WHEN least(129600000000, credit + n.us - f.us) >= 43200000000 THEN 43200000000 ELSE 0 END
  FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)""", recursive=True) + "SELECT event_id, allowed FROM f")
def rate_token_bucket(t):
    return limits.token_bucket(t.events, "user_id", "ts", "event_id", 3, 1 / 43200).select("event_id", "allowed")


@query("E25", sql(NUMBERED, """f AS (SELECT user_id, event_id, i, us, true AS allowed, CAST(43200000000 AS BIGINT) AS level FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.event_id, n.i, n.us, greatest(0, level - (n.us - f.us)) <= 43200000000,
  greatest(0, level - (n.us - f.us)) + CASE WHEN greatest(0, level - (n.us - f.us)) <= 43200000000 THEN 43200000000 ELSE 0 END
  FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)""", recursive=True) + "SELECT event_id, allowed FROM f")
def rate_leaky_bucket(t):
    return limits.leaky_bucket(t.events, "user_id", "ts", "event_id", 1 / 43200, 1).select("event_id", "allowed")


@query("E26", """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events)
SELECT event_id, rn <= coalesce(c_nationkey % 4, 0) AS allowed FROM r LEFT JOIN customer ON c_custkey = user_id AND c_mktsegment <> 'BUILDING'""")
def tenant_quota(t):
    quotas = t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 4).alias("quota"))
    return limits.quota(t.events, quotas, "user_id", "ts", "event_id", 86400).select("event_id", "allowed")
