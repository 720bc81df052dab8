"""How the given tables play the roles of logs, metrics and key-value state.

Every role exists twice: as a DataFrame function and as a SQL common table expression
of the same name, so that a query and its SQL start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.plans.registry import Tables

MONEY = "decimal(18,2)"

FLOW = """flow AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS srcaddr,
  CAST(l_partkey AS VARCHAR) AS dstaddr, l_linenumber AS dstport, l_linestatus AS protocol,
  CAST(l_quantity AS BIGINT) AS packets, CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes,
  CASE WHEN l_returnflag = 'R' THEN 'REJECT' ELSE 'ACCEPT' END AS action, l_shipdate AS start,
  CAST(l_shipdate AS DATE) AS "date", CAST(l_suppkey % 3 AS VARCHAR) AS account_id,
  CAST(l_suppkey % 4 AS VARCHAR) AS region, CAST(l_partkey % 16 AS VARCHAR) AS subnet_id,
  CAST(l_partkey % 8 AS VARCHAR) AS vpc_id, CAST(l_partkey % 64 AS VARCHAR) AS interface_id
  FROM lineitem)"""


def flow(t: Tables) -> DataFrame:
    li = t.lineitem
    text = lambda c: c.cast("string")
    return li.select(
        "l_orderkey", "l_linenumber", text(F.col("l_suppkey")).alias("srcaddr"),
        text(F.col("l_partkey")).alias("dstaddr"), F.col("l_linenumber").alias("dstport"),
        F.col("l_linestatus").alias("protocol"), F.col("l_quantity").cast("bigint").alias("packets"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("bytes"),
        F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("ACCEPT").alias("action"),
        F.col("l_shipdate").alias("start"), F.col("l_shipdate").cast("date").alias("date"),
        text(F.col("l_suppkey") % 3).alias("account_id"), text(F.col("l_suppkey") % 4).alias("region"),
        text(F.col("l_partkey") % 16).alias("subnet_id"), text(F.col("l_partkey") % 8).alias("vpc_id"),
        text(F.col("l_partkey") % 64).alias("interface_id"))


WEB = """web AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS client, event_type,
  '/p/' || json_extract_string(props, '$.k') ||
    CASE CAST(json_extract_string(props, '$.k') AS INT) % 10 WHEN 0 THEN '.css' WHEN 1 THEN '/admin'
    WHEN 2 THEN '/.env' ELSE '' END AS path,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status,
  CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  CAST(round(value * 100) AS BIGINT) AS bytes, CAST(value AS DECIMAL(18,2)) AS rt,
  CASE user_id % 7 WHEN 0 THEN 'ExampleBot/1.0' WHEN 1 THEN 'curl/8.0' WHEN 2 THEN '-'
    WHEN 3 THEN 'python-requests/2.31' ELSE 'Mozilla/5.0' END AS agent,
  CASE CAST(json_extract_string(props, '$.k') AS INT) % 4 WHEN 0 THEN 'HIT' WHEN 1 THEN 'MISS'
    WHEN 2 THEN 'EXPIRED' ELSE 'BYPASS' END AS cache,
  'EDGE' || CAST(user_id % 5 AS VARCHAR) AS edge
  FROM events)"""


def web(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    return t.events.select(
        "event_id", "ts", user.cast("string").alias("client"), "event_type",
        F.concat(F.lit("/p/"), k.cast("string"), F.when(k % 10 == 0, ".css").when(k % 10 == 1, "/admin")
                 .when(k % 10 == 2, "/.env").otherwise("")).alias("path"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404)
        .otherwise(200).alias("status"),
        F.when(F.col("event_type") == "purchase", "POST").otherwise("GET").alias("method"),
        F.round(F.col("value") * 100).cast("bigint").alias("bytes"), F.col("value").cast(MONEY).alias("rt"),
        F.when(user % 7 == 0, "ExampleBot/1.0").when(user % 7 == 1, "curl/8.0").when(user % 7 == 2, "-")
        .when(user % 7 == 3, "python-requests/2.31").otherwise("Mozilla/5.0").alias("agent"),
        F.when(k % 4 == 0, "HIT").when(k % 4 == 1, "MISS").when(k % 4 == 2, "EXPIRED")
        .otherwise("BYPASS").alias("cache"),
        F.concat(F.lit("EDGE"), (user % 5).cast("string")).alias("edge"))


EV = """ev AS (SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value,
  CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


def ev(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "user_id", "event_type", F.col("value").cast(MONEY).alias("value"),
                           F.get_json_object("props", "$.k").cast("int").alias("k"))


# Events as a collector with losses would store them: some users and some times are missing.
EV_GAPS = """ev_gaps AS (SELECT event_id, event_type, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 11 <> 0 THEN user_id END AS user_id,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 13 <> 0 THEN ts END AS ts, CAST(value AS DECIMAL(18,2)) AS value FROM events)"""


def ev_gaps(t: Tables) -> DataFrame:
    e = ev(t)
    return e.select("event_id", "event_type", F.when(F.col("k") % 11 != 0, F.col("user_id")).alias("user_id"),
                    F.when(F.col("k") % 13 != 0, F.col("ts")).alias("ts"), "value")


ZSET = """zset AS (SELECT CAST(user_id AS VARCHAR) AS member, CAST(count(*) AS BIGINT) AS score
  FROM events WHERE event_type = 'view' GROUP BY 1)"""


def zset(t: Tables) -> DataFrame:
    views = t.events.where(F.col("event_type") == "view")
    return views.groupBy(F.col("user_id").cast("string").alias("member")).agg(F.count(F.lit(1)).alias("score"))


PRODUCTS = """products AS (SELECT p_partkey AS id, p_name AS name, p_type AS category, p_brand AS brand,
  CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_size AS stock FROM part)"""


def products(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                         F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
                         F.col("p_retailprice").cast("decimal(10,2)").alias("price"), F.col("p_size").alias("stock"))


VERSIONS = """versions AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderdate AS ts,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS value FROM orders)"""


def versions(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"),
                           F.col("o_orderdate").alias("ts"),
                           F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("value"))


SEGMENTS = """segments AS (SELECT l_orderkey AS trace_id, CAST(l_linenumber AS BIGINT) AS segment_id,
  CAST(l_linenumber - 1 AS BIGINT) AS parent_id, CAST(l_suppkey AS VARCHAR) AS service,
  CAST(l_linenumber AS BIGINT) * 1000 AS start_ms,
  CAST(l_linenumber AS BIGINT) * 1000 + CAST(l_quantity AS BIGINT) AS end_ms,
  CASE l_returnflag WHEN 'R' THEN (CASE WHEN l_linestatus = 'O' THEN 500 ELSE 429 END)
    WHEN 'N' THEN (CASE WHEN l_linestatus = 'O' THEN 404 ELSE 200 END) ELSE 200 END AS status,
  l_linestatus AS annotation, l_shipdate AS ts FROM lineitem)"""


def segments(t: Tables) -> DataFrame:
    line = F.col("l_linenumber").cast("bigint")
    opened = F.col("l_linestatus") == "O"
    return t.lineitem.select(
        F.col("l_orderkey").alias("trace_id"), line.alias("segment_id"), (line - 1).alias("parent_id"),
        F.col("l_suppkey").cast("string").alias("service"), (line * 1000).alias("start_ms"),
        (line * 1000 + F.col("l_quantity").cast("bigint")).alias("end_ms"),
        F.when((F.col("l_returnflag") == "R") & opened, 500).when(F.col("l_returnflag") == "R", 429)
        .when((F.col("l_returnflag") == "N") & opened, 404).otherwise(200).alias("status"),
        F.col("l_linestatus").alias("annotation"), F.col("l_shipdate").alias("ts"))


# Addresses: internal 10.a.b.c built from the part key, every fifth one external 52.a.b.c.
NET = """net AS (SELECT l_orderkey, l_linenumber, l_suppkey AS src_ip_n,
  '10.0.' || CAST(l_suppkey // 256 % 256 AS VARCHAR) || '.' || CAST(l_suppkey % 256 AS VARCHAR) AS srcaddr,
  CASE WHEN l_partkey % 5 = 0 THEN '52.' ELSE '10.' END || CAST(l_partkey // 65536 % 256 AS VARCHAR) || '.' ||
    CAST(l_partkey // 256 % 256 AS VARCHAR) || '.' || CAST(l_partkey % 256 AS VARCHAR) AS dstaddr,
  l_linenumber AS dstport, CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes, l_shipdate AS ts FROM lineitem)"""


def net(t: Tables) -> DataFrame:
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    octet = lambda c, shift: F.shiftright(c, shift).bitwiseAND(F.lit(255)).cast("string")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.concat_ws(".", F.lit("10.0"), octet(s, 8), octet(s, 0)).alias("srcaddr"),
        F.concat_ws(".", F.when(p % 5 == 0, "52").otherwise("10"), octet(p, 16), octet(p, 8), octet(p, 0)).alias("dstaddr"),
        F.col("l_linenumber").alias("dstport"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("bytes"),
        F.col("l_shipdate").alias("ts"))


# Nested prefixes: one /24 per nation and one /16 per region.
INVENTORY = """inventory AS (SELECT '10.0.' || CAST(n_nationkey AS VARCHAR) || '.0/24' AS cidr, n_name AS owner FROM nation
  UNION ALL SELECT '10.' || CAST(r_regionkey AS VARCHAR) || '.0.0/16', r_name FROM region),
  ranges AS (SELECT cidr, owner, CAST(split_part(cidr, '/', 2) AS INT) AS len,
    CAST(split_part(cidr, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(cidr, '.', 2) AS BIGINT) * 65536
    + CAST(split_part(cidr, '.', 3) AS BIGINT) * 256 AS lo FROM inventory)"""


def inventory(t: Tables) -> DataFrame:
    small = t.nation.select(F.format_string("10.0.%d.0/24", "n_nationkey").alias("cidr"), F.col("n_name").alias("owner"))
    return small.unionByName(t.region.select(F.format_string("10.%d.0.0/16", "r_regionkey").alias("cidr"),
                                             F.col("r_name").alias("owner")))


def sql(*ctes: str, recursive: bool = False) -> str:
    """``WITH`` clause from role expressions."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def ntz_literal(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
