"""Registered queries: scans, parsers, sinks and layouts (A1-A17). Files are written below the shared folder and read back."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from opsloom.functions.timeutil import micros
from opsloom.plans.registry import query
from opsloom.plans.roles import EV, WEB, ev, sql, web
from opsloom.sources import scan, sinks
from opsloom.session import work_path


@query("A1", "SELECT p_partkey, p_brand FROM part")
def scan_two_columns(t):
    return scan.scan_parquet(t.spark, f"{t.path}/part.parquet", ["p_partkey", "p_brand"])


def flow_lines(t):
    """Line items written as 29-field flow records; most optional fields are absent."""
    filled = {"version": F.lit(5), "account_id": F.col("l_suppkey") % 3, "srcaddr": F.col("l_suppkey"), "dstaddr": F.col("l_partkey"),
              "srcport": F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") % 60000), "dstport": F.col("l_linenumber"),
              "protocol": F.lit(6), "packets": F.col("l_quantity").cast("bigint"), "bytes": F.round(F.col("l_extendedprice") * 100).cast("bigint"),
              "start": F.floor(micros("l_shipdate") / 1_000_000), "end": F.floor(micros("l_shipdate") / 1_000_000) + 60,
              "action": F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("ACCEPT"), "log_status": F.lit("OK"),
              "region": F.concat(F.lit("r"), (F.col("l_suppkey") % 2).cast("string"))}
    names = [f.split()[0].strip("`") for f in scan.FLOW_SCHEMA.replace("\n", " ").split(",")]
    return t.lineitem.select(*[filled.get(n, F.lit(None)).cast("string").alias(n) for n in names])


@query("A2", """SELECT CAST(l_suppkey AS VARCHAR) AS srcaddr, l_shipdate AS start, count(*) AS flows,
CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS bytes, count(*) FILTER (l_linenumber = 1) AS no_port FROM lineitem GROUP BY 1, 2""")
def scan_flow_records(t):
    path = work_path(t.spark, "flow")
    flow_lines(t).write.option("sep", " ").option("nullValue", "-").csv(path)
    flows = scan.scan_flow_logs(t.spark, path)
    return flows.groupBy("srcaddr", "start").agg(F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"),
                                                 F.count_if(F.col("srcport").isNull()).alias("no_port"))


def access_log(t):
    """Events written as access-log text files; every 50th line is cut short. The referer carries the event id."""
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    rt = F.col("rt").cast("string")
    extra = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" rt="), rt, F.lit(" urt="), F.when(
        F.col("event_id") % 4 == 0, "-").otherwise(rt), F.lit(" cs="), "cache")).otherwise("")
    line = F.concat(F.format_string('%s - - [%s +0000] "%s %s HTTP/1.1" %d %d "%d" "%s"', "client", stamp, "method", "path", "status",
                                    "bytes", "event_id", "agent"), extra)
    path = work_path(t.spark, "access")
    web(t).select(F.when(F.col("event_id") % 50 == 7, F.substring(line, 1, 20)).otherwise(line)).write.text(path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query("A3", sql(WEB) + """SELECT event_id, client, date_trunc('second', ts) AS ts, method, path, status, bytes, agent,
CASE WHEN event_id % 2 = 0 THEN CAST(rt AS DOUBLE) ELSE -1 END AS rt, CASE WHEN event_id % 4 = 2 THEN CAST(rt AS DOUBLE) ELSE -1 END AS urt,
CASE WHEN event_id % 2 = 0 THEN cache ELSE '' END AS cache FROM web WHERE event_id % 50 <> 7""")
def parsed_access_log(t):
    good, _ = scan.parse_access_log(access_log(t))
    return good.select(F.col("referer").cast("bigint").alias("event_id"), "client", F.col("ts").cast("timestamp_ntz").alias("ts"), "method",
                       "path", "status", "bytes", "agent", F.coalesce("rt", F.lit(-1.0)).alias("rt"), F.coalesce("urt", F.lit(-1.0)).alias("urt"),
                       F.coalesce("cache", F.lit("")).alias("cache"))


@query("A3", "SELECT substr(user_id || strftime(ts, ' - - [%d/%b/%Y:%H:%M:%S +0000] '), 1, 20) AS line FROM events WHERE event_id % 50 = 7")
def unparsed_access_lines(t):
    return scan.parse_access_log(access_log(t))[1]


def _json_lines(t):
    body = F.to_json(F.struct(F.col("client").alias("ip"), F.lit("shop").alias("host"), F.concat_ws(" ", "method", "path").alias("request"), "status"))
    return web(t).select("event_id", F.when(F.col("event_id") % 40 == 3, F.substring(body, 1, 15)).otherwise(body).alias("line"))


JSON_LOG = "ip string, host string, request string, status int"


@query("A4", sql(WEB) + """SELECT event_id, client AS ip, 'shop' AS host, method || ' ' || path AS request, status FROM web WHERE event_id % 40 <> 3""")
def parsed_json_log(t):
    return scan.parse_json_log(_json_lines(t), JSON_LOG)[0]


@query("A4", "SELECT event_id FROM events WHERE event_id % 40 = 3")
def corrupt_json_log(t):
    return scan.parse_json_log(_json_lines(t), JSON_LOG)[1].select("event_id")


@query("A5", sql(EV) + "SELECT event_id, CAST(user_id AS VARCHAR) AS who, event_type AS what FROM ev")
def parse_glob_message(t):
    lines = ev(t).select("event_id", F.format_string("user %d did %s", "user_id", "event_type").alias("message"))
    return scan.parse_glob(lines, "message", "user * did *", ["who", "what"]).drop("message")


@query("A6 A12", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) = 1997")
def scan_one_year(t):
    path = work_path(t.spark, "years")
    sinks.write_columnar(t.orders.withColumn("year", F.year("o_orderdate")), path, by=["year"])
    return scan.scan_partitioned(t.spark, path, F.col("year") == 1997).select("o_orderkey", "year")


@query("A7", """SELECT CAST(l_suppkey % 3 AS VARCHAR) AS account, 'r' || l_suppkey % 2 AS zone, strftime(l_shipdate, '%Y-%m') AS day, count(*) AS flows
FROM lineitem WHERE l_suppkey % 3 IN (0, 2) AND l_suppkey % 2 = 1 AND l_shipdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-05-31' GROUP BY 1, 2, 3""")
def scan_projected_partitions(t):
    path = work_path(t.spark, "projected")
    lines = flow_lines(t)
    day = F.date_format(F.timestamp_seconds(F.col("start").cast("bigint")), "yyyy-MM")
    # Range partitioning keeps a folder's rows together, and its last key splits a hot folder.
    lines.repartitionByRange("account_id", "region", day, "dstaddr").select("*", F.col("account_id").alias("account"), F.col("region").alias("zone"), day.alias("day")).write.partitionBy(
        "account", "zone", "day").option("sep", " ").option("nullValue", "-").csv(path)
    template = path + "/account=${account}/zone=${zone}/day=${day}"
    rows = scan.scan_projected(t.spark, template, {"account": ["0", "2", "9"], "zone": ["r1"]}, (date(1997, 3, 1), date(1997, 5, 31)),
                               day_format="%Y-%m")
    return rows.groupBy("account", "zone", "day").agg(F.count(F.lit(1)).alias("flows"))


def _segment_table(t):
    path, table = work_path(t.spark, "segments"), "opsloom_" + uuid.uuid4().hex[:10]
    sinks.write_columnar(t.customer.select("c_custkey", "c_mktsegment"), path, by=["c_mktsegment"])
    scan.partitioned_table(t.spark, table, path, "c_custkey BIGINT, c_mktsegment STRING", "c_mktsegment")
    return path, table


@query("A8", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def added_partition(t):
    path, table = _segment_table(t)
    scan.add_partition(t.spark, table, {"c_mktsegment": "BUILDING"}, f"{path}/c_mktsegment=BUILDING")
    return t.spark.table(table)


@query("A8", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def repaired_table(t):
    _, table = _segment_table(t)
    scan.repair(t.spark, table)
    return t.spark.table(table).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("A16", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'FURNITURE'")
def dropped_partitions(t):
    _, table = _segment_table(t)
    scan.repair(t.spark, table)
    sinks.drop_partitions(t.spark, table, "c_mktsegment", "FURNITURE")
    return t.spark.table(table)


@query("A10", """SELECT r_name, n_name, n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey""")
def flattened_nations(t):
    # 25 nations in one array per region: the nesting is bounded by the table's fixed size.
    nested = (t.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", "n_nationkey")).alias("nations"))
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
              .select("r_name", F.array(F.struct("nations")).alias("groups")))
    return scan.flatten(nested, "groups[*].nations[*]", {"n_name": "n_name", "id": "n_nationkey"}, keep=["r_name"])


@query("A10", """SELECT event_id, word FROM (SELECT event_id, unnest([event_type, 'u' || user_id]) AS word FROM events)""")
def flattened_event_tags(t):
    nested = t.events.select("event_id", F.array(F.struct(F.col("event_type").alias("name")), F.struct(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"))).alias("tags"))
    return scan.flatten(nested, "tags[*]", {"word": "name"}, keep=["event_id"])


@query("A12 A13", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_to_orc(t):
    raw, orc = work_path(t.spark, "json"), work_path(t.spark, "orc")
    ev(t).select("event_id", "event_type", "k").write.option("compression", "gzip").json(raw)
    parsed = t.spark.read.schema("event_id bigint, event_type string, k int").json(raw)
    sinks.write_columnar(parsed, orc, "orc", codec="zlib")
    return t.spark.read.orc(orc)


@query("A13", "SELECT c_custkey, c_mktsegment FROM customer")
def gzip_parquet(t):
    path = work_path(t.spark, "gzip")
    sinks.write_columnar(t.customer.select("c_custkey", "c_mktsegment"), path, codec="gzip")
    return t.spark.read.parquet(path)


@query("A14", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'")
def incremental_export(t):
    path = work_path(t.spark, "export")
    sinks.export(t.events.select("event_id", "ts"), path, "ts", "2024-01-10", "2024-01-17")
    return t.spark.read.parquet(path).select("event_id")


@query("A15", "SELECT year(o_orderdate) || 'q' || quarter(o_orderdate) AS part, count(*) AS n FROM orders GROUP BY 1")
def range_layout(t):
    path = work_path(t.spark, "quarters")
    sinks.write_partitioned(t.orders, path, "range", "o_orderdate")
    return t.spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("A15", """SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'industry' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'home'
ELSE 'default' END AS part, count(*) AS n FROM customer GROUP BY 1""")
def list_layout(t):
    path = work_path(t.spark, "lists")
    sinks.write_partitioned(t.customer, path, "list", "c_mktsegment", groups={"industry": ["BUILDING", "MACHINERY"], "home": ["HOUSEHOLD"]})
    return t.spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("A15 H18", """SELECT CAST(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS INT) AS part, count(*) AS n FROM customer GROUP BY 1""")
def hash_layout(t):
    path = work_path(t.spark, "hash")
    sinks.write_partitioned(t.customer, path, "hash", "c_custkey", n=4)
    return t.spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def bucketed_pair(t):
    tables = []
    for df, key in ((t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey"),
                    (t.lineitem.select("l_orderkey", "l_quantity"), "l_orderkey")):
        table = "opsloom_" + uuid.uuid4().hex[:10]
        sinks.write_bucketed(df, table, work_path(t.spark, "buckets"), key, 8)
        tables.append(t.spark.table(table))
    return tables


@query("A15 C1", """SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def bucketed_join(t):
    orders, lines = bucketed_pair(t)
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("A17", "SELECT p_partkey FROM part UNION ALL SELECT p_partkey + 5000000 FROM part WHERE p_size < 5")
def loaded_products(t):
    path = work_path(t.spark, "load")
    sinks.load(t.part.select("p_partkey"), path)
    sinks.load(t.part.where("p_size < 5").select((F.col("p_partkey") + 5000000).alias("p_partkey")), path)
    return t.spark.read.parquet(path)
