"""Registered queries: sorted sets, versions, lists, replay, pages and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.functions.ordered import slots
from opsloom.functions.timeutil import time_chunk
from opsloom.operators import ranking as op, sets
from opsloom.plans.registry import query
from opsloom.plans.roles import EV, EV_GAPS, PRODUCTS, VERSIONS, WEB, ZSET, ev, ev_gaps, ntz_literal, products, sql, versions, web, zset
from opsloom.session import work_path


@query("E1", sql(ZSET) + """SELECT member, score, CAST(row_number() OVER (ORDER BY score DESC, member DESC) AS INT) AS rank
FROM zset ORDER BY score DESC, member DESC LIMIT 10""")
def leaderboard(t):
    return op.leaderboard(zset(t), 10)


@query("E2", sql(ZSET) + "SELECT member, score FROM zset ORDER BY score, member LIMIT 11 OFFSET 5")
def zrange_by_position(t):
    return op.zrange(zset(t), 5, 15)


@query("E2", sql(ZSET) + "SELECT member, score FROM zset ORDER BY score DESC, member DESC LIMIT 20")
def zrange_last_twenty(t):
    return op.zrange(zset(t), -20, -1)


@query("E2", sql(ZSET) + """SELECT member, score FROM (SELECT *, row_number() OVER (ORDER BY score, member) AS rn, count(*) OVER () AS n FROM zset)
WHERE rn >= 4 AND rn <= n - 10""")
def zrange_mixed_ends(t):
    return op.zrange(zset(t), 3, -11)


@query("E2", sql(ZSET) + """SELECT member, score, pos FROM (SELECT *, row_number() OVER (ORDER BY score, member) - 1 AS pos, count(*) OVER () AS n FROM zset)
WHERE pos BETWEEN n // 2 AND n // 2 + 9 OR pos >= n - 3""")
def zrange_deep_by_directory(t):
    stored = op.Ordered.write(zset(t), work_path(t.spark, "zset"), [("score", False), ("member", False)])
    middle = stored.size() // 2
    return stored.slice(middle, middle + 9).union(stored.slice(-3, -1))


@query("E3", sql(ZSET) + "SELECT member, score, row_number() OVER (ORDER BY score, member) - 1 AS rank FROM zset")
def zrank_all(t):
    return op.zranks(zset(t))


@query("E3", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders")
def order_value_rank(t):
    from opsloom.functions.ordered import global_position
    return global_position(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")]).drop("o_totalprice")


@query("E3", sql(ZSET) + """SELECT rank FROM (SELECT member, row_number() OVER (ORDER BY score DESC, member DESC) - 1 AS rank FROM zset) WHERE member = '17'""")
def zrevrank_one(t):
    return op.zrank(zset(t), "17", reverse=True)


@query("E4", sql(ZSET) + "SELECT score FROM zset WHERE member = '17'")
def zscore(t):
    return op.zscore(zset(t), "17")


@query("E5", sql(EV) + "SELECT CAST(user_id AS VARCHAR) AS member, CAST(sum(k) AS BIGINT) AS score FROM ev GROUP BY 1")
def zset_increments(t):
    return op.zset_from_events(ev(t), "user_id", "k", ["ts", "event_id"])


@query("E5", sql(EV) + "SELECT CAST(user_id AS VARCHAR) AS member, arg_max(k, event_id) AS score FROM ev GROUP BY 1")
def zset_last_score(t):
    return op.zset_from_events(ev(t), "user_id", "k", ["ts", "event_id"], "set")


@query("E6", sql(ZSET) + "SELECT member, score FROM zset WHERE score BETWEEN 10 AND 14")
def zrange_by_score(t):
    return op.zrange_by_score(zset(t), 10, 14)


@query("E6", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10'")
def due_jobs(t):
    return op.due(t.events, "ts", ntz_literal("2024-01-10")).select("event_id")


@query("E7", sql(ZSET) + "SELECT member, score FROM zset WHERE NOT score BETWEEN 10 AND 14")
def zremove_by_score(t):
    return op.zrem_by_score(zset(t), 10, 14)


@query("E8", sql(ZSET) + "SELECT member, score FROM zset ORDER BY score, member LIMIT 10")
def zpop_min(t):
    return op.zpop(zset(t), 10)[0]


@query("E8", sql(ZSET) + "SELECT member, score FROM zset WHERE member NOT IN (SELECT member FROM zset ORDER BY score DESC, member DESC LIMIT 10)")
def zpop_max_rest(t):
    return op.zpop(zset(t), 10, "max")[1]


@query("D55", sql(ZSET) + "SELECT count(*) AS n FROM zset")
def zcard(t):
    return op.zcard(zset(t))


@query("D55", sql(ZSET) + "SELECT count(*) AS n FROM zset WHERE score BETWEEN 10 AND 14")
def zcount(t):
    return op.zcount(zset(t), 10, 14)


@query("E9", sql(VERSIONS) + """SELECT k, seq, ts FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, seq DESC) AS rn FROM versions) WHERE rn = 1""")
def latest_version(t):
    return op.latest_by(versions(t), ["k"], ["ts", "seq"]).select("k", "seq", "ts")


@query("E10", sql(VERSIONS) + """SELECT k, seq, ts FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, seq) AS rn FROM versions) WHERE rn = 1""")
def first_version(t):
    return op.first_by(versions(t), ["k"], ["ts", "seq"]).select("k", "seq", "ts")


@query("E11", """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
FROM events) WHERE rn <= 5""")
def keep_last_per_user(t):
    return op.keep_last(t.events, "user_id", ["ts", "event_id"], "event_id", 5).select("event_id", "user_id")


LIST = """l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


@query("E12", sql(LIST) + "SELECT user_id, event_id, pos FROM l WHERE pos BETWEEN 2 AND 6")
def list_range(t):
    return op.lrange(t.events, "user_id", ["ts", "event_id"], time_chunk("ts", 86400), 2, 6).select("user_id", "event_id", "pos")


@query("E12", sql(LIST) + "SELECT user_id, event_id, pos FROM l WHERE pos >= n - 3")
def list_tail(t):
    return op.lrange(t.events, "user_id", ["ts", "event_id"], time_chunk("ts", 86400), -3, -1).select("user_id", "event_id", "pos")


SIGNED = """signed AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('signup', 'purchase') THEN value
  WHEN event_type = 'error' THEN -value ELSE 0 END AS amount FROM ev)"""


def signed(t):
    value = F.when(F.col("event_type").isin("signup", "purchase"), F.col("value")).when(
        F.col("event_type") == "error", -F.col("value")).otherwise(F.lit(0))
    return ev(t).select("event_id", "user_id", "ts", value.cast("decimal(18,2)").alias("amount"))


@query("E13", sql(EV, SIGNED) + """SELECT event_id, user_id, CAST(sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS balance FROM signed""")
def replay_running(t):
    return op.replay(signed(t), "user_id", ["ts", "event_id"], "amount", time_chunk("ts", 86400)).select("event_id", "user_id", "balance")


@query("E13", sql(EV_GAPS) + """SELECT event_id, user_id, CAST(sum(value) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS DOUBLE) AS balance
FROM ev_gaps""")
def replay_running_with_nulls(t):
    """Null users are one user; rows without a time come first."""
    return op.replay(ev_gaps(t), "user_id", ["ts", "event_id"], "value", time_chunk("ts", 86400)).select("event_id", "user_id", "balance")


@query("E13", sql(EV, SIGNED) + "SELECT user_id, CAST(sum(amount) AS DOUBLE) AS balance FROM signed GROUP BY 1")
def replay_final(t):
    return op.replay_final(signed(t), "user_id", "amount")


@query("E14", sql(EV, SIGNED) + "SELECT user_id, CAST(sum(amount) AS DOUBLE) AS balance FROM signed GROUP BY 1")
def replay_from_snapshot(t):
    events = signed(t)
    # Snapshots of 12 January; users without earlier events replay everything.
    snap = (events.where(F.col("ts") < ntz_literal("2024-01-12")).groupBy("user_id")
            .agg(F.sum("amount").alias("balance"), F.max("event_id").alias("snap_seq")))
    return op.replay_from(snap, events, "user_id", "event_id", "amount")


@query("E15", sql(VERSIONS) + """SELECT k, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, seq DESC) AS rn
FROM versions WHERE ts <= TIMESTAMP '1998-06-30') WHERE rn = 1""")
def state_as_of(t):
    return op.as_of(versions(t), ["k"], ["ts", "seq"], ntz_literal("1998-06-30")).select("k", "seq")


@query("F1", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def order_by_balance(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("F2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("F3", """SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH') AS total, 3 AS page FROM orders
WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def page_by_offset(t):
    return op.page(t.orders, 40, 20, "o_orderdate", "o_orderkey", F.col("o_orderpriority") == "2-HIGH").select("o_orderkey", "total", "page")


@query("F3", """SELECT o_orderkey, count(*) OVER () AS total, CAST(pos // 20 + 1 AS INT) AS page FROM (SELECT o_orderkey,
row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos FROM orders)
QUALIFY pos // 20 + 1 IN (1, 400, (SELECT count(*) FROM orders) // 20)""")
def page_by_directory(t):
    stored = op.Ordered.write(t.orders.select("o_orderkey", "o_orderdate"), work_path(t.spark, "pages"), [("o_orderdate", True), ("o_orderkey", False)])
    pages = [stored.page(number, 20) for number in (1, 400, stored.size() // 20)]
    return reduce(DataFrame.union, pages).select("o_orderkey", "total", "page")


@query("F4", "SELECT o_orderkey, '125' AS next_token FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 25")
def page_by_key(t):
    return op.page_after(t.orders, "o_orderkey", 100, 25).select("o_orderkey", "next_token")


@query("F5", """SELECT o_orderkey FROM (SELECT * FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25) WHERE o_orderstatus = 'F'""")
def page_then_filter(t):
    return op.page_after(t.orders, "o_orderkey", 100, 25, F.col("o_orderstatus") == "F").select("o_orderkey")


def stream_entries(t):
    return t.events.select("event_id", F.concat_ws("-", F.unix_millis(F.col("ts").cast("timestamp")).cast("string"),
                                                   (F.col("event_id") % 3).cast("string")).alias("id"), "ts")


def unique_entries(t):
    """Entries whose ids are unique: a limit over them cuts at one defined row."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    return t.events.select("event_id", F.concat_ws("-", ms, F.col("event_id").cast("string")).alias("id"))


@query("F6", "SELECT event_id FROM events ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC LIMIT 40")
def newest_entries(t):
    return op.tail(unique_entries(t), "id", 40).select("event_id")


@query("F6", "SELECT event_id FROM events ORDER BY epoch_us(ts) // 1000, event_id LIMIT 40")
def oldest_entries(t):
    return op.head(unique_entries(t), "id", 40).select("event_id")


@query("F7", sql(WEB) + "SELECT event_id, CAST(rt AS DOUBLE) AS rt FROM web ORDER BY web.rt DESC, event_id LIMIT 20")
def slowest_requests(t):
    return op.slowest(web(t), 20).select("event_id", "rt")


@query("F9", "SELECT o_orderkey FROM orders WHERE o_custkey = 77 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def newest_of_customer(t):
    return op.latest_for(t.orders, "o_custkey", 77, "o_orderdate", "o_orderkey").select("o_orderkey")


@query("F8", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 60")
def drain_queue(t):
    return op.drain(t.orders, 60, "o_orderpriority", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderpriority")


def _users(t, kind):
    return t.events.where(F.col("event_type") == kind).select("user_id")


USERS = "SELECT user_id FROM events WHERE event_type = '{}'"


@query("G1", f"{USERS.format('signup')} UNION {USERS.format('error')}")
def set_union(t):
    return sets.sunion(_users(t, "signup"), _users(t, "error"))


@query("G2", f"{USERS.format('signup')} INTERSECT {USERS.format('error')} INTERSECT {USERS.format('view')}")
def set_intersection(t):
    return sets.sinter(_users(t, "signup"), _users(t, "error"), _users(t, "view"))


@query("G3", "SELECT o_custkey AS id FROM orders EXCEPT SELECT s_suppkey FROM supplier EXCEPT SELECT n_nationkey FROM nation")
def set_difference(t):
    return sets.sdiff(t.orders.select(F.col("o_custkey").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id")),
                      t.nation.select(F.col("n_nationkey").alias("id")))


@query("G4", f"{USERS.format('signup')} UNION {USERS.format('error')}")
def set_union_store(t):
    return sets.store(sets.sunion(_users(t, "signup"), _users(t, "error")), work_path(t.spark, "set-store"))


OPS = """ops AS (SELECT event_type AS grp, user_id, event_id, CASE WHEN k % 3 = 0 THEN 'remove' ELSE 'add' END AS op FROM ev)"""


@query("G5", sql(EV, OPS) + "SELECT grp, user_id FROM ops GROUP BY 1, 2 HAVING arg_max(op, event_id) = 'add'")
def set_from_log(t):
    log = ev(t).select(F.col("event_type").alias("grp"), "user_id", "ts", "event_id",
                       F.when(F.col("k") % 3 == 0, "remove").otherwise("add").alias("op"))
    return sets.set_from_events(log, "grp", "user_id", "op", ["ts", "event_id"])


@query("G5", """SELECT DISTINCT CASE WHEN event_type = 'view' AND user_id = 9 THEN 'click' ELSE event_type END AS event_type, user_id FROM events""")
def set_move(t):
    return sets.smove(t.events.select("event_type", "user_id"), "event_type", "user_id", "view", "click", 9)


@query("G6", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def set_sizes(t):
    return sets.scard(t.events, "event_type", "user_id")


@query("G6", "SELECT count(*) > 0 AS is_member FROM events WHERE event_type = 'purchase' AND user_id = 3")
def set_is_member(t):
    return sets.sismember(t.events, "event_type", "user_id", "purchase", 3)


@query("G6", "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def set_members(t):
    return sets.smembers(t.events, "event_type", "user_id", "purchase")


@query("G7", "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def common_members(t):
    return sets.common(t.orders, "o_orderpriority", "o_custkey", "1-URGENT", "5-LOW")


@query("D25 C1", sql(PRODUCTS) + "SELECT brand, CAST(sum(price * stock) AS DOUBLE) AS value FROM products GROUP BY 1 ORDER BY 2 DESC LIMIT 10")
def inventory_value_by_brand(t):
    return (products(t).groupBy("brand").agg(F.sum(F.col("price") * F.col("stock")).alias("value"))
            .orderBy(F.desc("value")).limit(10))


@query("H22", """SELECT event_id, epoch_ms(date_trunc('hour', ts)) || '-' ||
(row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) - 1) AS id FROM events""")
def sequence_ids(t):
    from opsloom.functions.scalars import sequence_id
    from opsloom.functions.timeutil import floor_time
    hourly = t.events.withColumn("slot", floor_time("ts", 3600))
    return sequence_id(hourly, "slot", ["ts", "event_id"], slots("event_id", 1000)).select("event_id", "id")
