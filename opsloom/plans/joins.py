"""Registered queries: joins, address enrichment, as-of and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import addresses, graph, joins as op, membership
from opsloom.plans.registry import query
from opsloom.plans.roles import EV, EV_GAPS, INVENTORY, NET, PRODUCTS, ev, ev_gaps, inventory, net, products, sql
from opsloom.session import cut_lineage, work_path


@query("C2", """SELECT l_orderkey, l_linenumber, o_orderpriority, p_name, s_name, n_name FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey WHERE l_orderkey = 77""")
def star_join_one_order(t):
    rows = op.star_join(t.lineitem, F.col("l_orderkey") == 77, [
        ("l_orderkey", t.orders, "o_orderkey"), ("l_partkey", t.part, "p_partkey"),
        ("l_suppkey", t.supplier, "s_suppkey"), ("s_nationkey", t.nation, "n_nationkey")])
    return rows.select("l_orderkey", "l_linenumber", "o_orderpriority", "p_name", "s_name", "n_name")


SUMMARY = """SELECT p_partkey AS product_id, p_brand, coalesce(avg_rating, 0) AS avg_rating, coalesce(n, 0) AS review_count,
  coalesce(p_size, 0) AS stock_quantity FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_rating,
  count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30 GROUP BY 1) ON l_partkey = p_partkey"""


@query("C3 I19", SUMMARY)
def product_summary(t):
    reviews = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 30").select(
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("decimal(18,2)").alias("rating"))
    items = t.part.select(F.col("p_partkey").alias("product_id"), "p_brand")
    stock = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_size").alias("stock_quantity"))
    return op.product_summary(items, reviews, stock)


@query("C4", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
AND o_orderdate >= TIMESTAMP '2000-01-01' AND o_totalprice > 400000)""")
def customers_with_large_orders(t):
    large = t.orders.where((F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("o_totalprice") > 400000))
    return op.where_exists_in(t.customer, large, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("C5", sql(EV, PRODUCTS) + """SELECT event_id, k AS id, coalesce(name, 'Product ' || k) AS name FROM ev
LEFT JOIN products ON id = k AND stock > 25 WHERE event_type = 'view'""")
def enriched_views(t):
    views = ev(t).where(F.col("event_type") == "view").select("event_id", F.col("k").alias("id"))
    return op.enrich_names(views, products(t).where("stock > 25").select(F.col("id").cast("int").alias("id"), "name"), "id", "name")


@query("C7", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT s_suppkey * 20 FROM supplier)")
def batch_get(t):
    keys = t.supplier.select((F.col("s_suppkey") * 20).alias("c_custkey"))
    return op.batch_get(t.customer.select("c_custkey", "c_name"), keys, "c_custkey")


@query("C8", """SELECT DISTINCT s_suppkey, s_name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_partkey = 42""")
def suppliers_of_part(t):
    bridge = t.lineitem.select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("s_suppkey"))
    return op.related(bridge, t.supplier.select("s_suppkey", "s_name"), "part_id", "s_suppkey", 42)


IP = """CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536
  + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT)"""
OWNED = (INVENTORY + ",\n  ips AS (SELECT DISTINCT srcaddr AS ip FROM net UNION SELECT DISTINCT dstaddr FROM net),\n"
         "  owned AS (SELECT ip, arg_max(owner, len) AS owner, max(len) AS prefix_len FROM ips JOIN ranges ON " + IP.format("ip") +
         " BETWEEN lo AND lo + CAST(pow(2, 32 - len) AS BIGINT) - 1 GROUP BY 1)")


@query("C9", sql(NET, OWNED) + """SELECT l_orderkey, l_linenumber, dstaddr, coalesce(owner, 'external') AS owner,
coalesce(prefix_len, -1) AS prefix_len FROM net LEFT JOIN owned ON ip = dstaddr""")
def cidr_enrichment(t):
    rows = op.cidr_enrich(net(t), "dstaddr", inventory(t), ["owner"])
    return rows.select("l_orderkey", "l_linenumber", "dstaddr", F.coalesce("owner", F.lit("external")).alias("owner"),
                       F.coalesce("prefix_len", F.lit(-1)).alias("prefix_len"))


@query("C9", sql(NET, OWNED) + """SELECT dstaddr, coalesce(owner, 'external') AS owner, count(*) AS flows
FROM net LEFT JOIN owned ON ip = dstaddr GROUP BY 1, 2""")
def cidr_enrichment_mixed_families(t):
    other = t.part.select(F.format_string("2001:db8:%x::/%d", F.col("p_partkey"), F.lit(33) + F.col("p_size")).alias("cidr"),
                          F.col("p_name").alias("owner"))
    rows = op.cidr_enrich(net(t), "dstaddr", inventory(t).unionByName(other), ["owner"])
    return rows.groupBy("dstaddr", F.coalesce("owner", F.lit("external")).alias("owner")).agg(F.count(F.lit(1)).alias("flows"))


DUAL = """dual AS (SELECT o_orderkey, o_custkey, o_orderkey % 7 = 0 AS outside, o_orderkey % 5 = 0 AS v4, o_custkey % 32 AS g3, o_custkey % 256 AS g4 FROM orders),
six AS (SELECT o_orderkey, CASE WHEN outside THEN NULL WHEN r_name IS NOT NULL AND g4 BETWEEN 64 AND 127 THEN r_name WHEN n_name IS NOT NULL THEN n_name ELSE 'AFRICA' END AS owner,
  CASE WHEN outside THEN NULL WHEN r_name IS NOT NULL AND g4 BETWEEN 64 AND 127 THEN 58 WHEN n_name IS NOT NULL THEN 48 ELSE 29 END AS prefix_len
  FROM dual LEFT JOIN region ON r_regionkey = g3 LEFT JOIN nation ON n_nationkey = g3 WHERE NOT v4),
four AS (SELECT o_orderkey, coalesce(n_name, r_name) AS owner, CASE WHEN n_name IS NOT NULL THEN 24 WHEN r_name IS NOT NULL THEN 16 END AS prefix_len
  FROM dual LEFT JOIN region ON r_regionkey = o_custkey % 8 LEFT JOIN nation ON o_custkey % 8 = 0 AND n_nationkey = o_orderkey % 256 WHERE v4)"""


@query("C9", sql(DUAL) + """SELECT o_orderkey, coalesce(owner, 'external') AS owner, coalesce(prefix_len, -1) AS prefix_len FROM six
UNION ALL SELECT o_orderkey, coalesce(owner, 'external'), coalesce(prefix_len, -1) FROM four""")
def cidr_ranges_both_families(t):
    # Nested prefixes of both families; addresses come in two spellings of IPv6 and as IPv4.
    nets = (inventory(t).unionByName(t.nation.select(F.format_string("2001:db8:%x::/48", "n_nationkey").alias("cidr"), F.col("n_name").alias("owner")))
            .unionByName(t.region.select(F.format_string("2001:DB8:%x:40::/58", "r_regionkey").alias("cidr"), F.col("r_name").alias("owner")))
            .unionByName(t.region.where("r_regionkey = 0").select(F.lit("2001:db8::/29").alias("cidr"), F.col("r_name").alias("owner"))))
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    site = F.when(order % 7 == 0, "2001:dc0").when(order % 2 == 0, "2001:0DB8").otherwise("2001:db8")
    six = F.concat_ws(":", site, F.format_string("%x:%x::%x:%x", cust % 32, cust % 256, F.floor(order / 65536), order % 65536))
    four = F.format_string("10.%d.%d.%d", cust % 8, order % 256, cust % 250)
    rows = t.orders.select("o_orderkey", F.when(order % 5 == 0, four).otherwise(six).alias("address"))
    found = addresses.enrich_addresses(rows, "address", addresses.prefix_boundaries(nets, ["owner"]))
    return found.select("o_orderkey", F.coalesce("owner", F.lit("external")).alias("owner"), F.coalesce("prefix_len", F.lit(-1)).alias("prefix_len"))


@query("C13", sql(EV_GAPS) + """, p AS (SELECT * FROM ev_gaps WHERE event_type = 'purchase'),
c AS (SELECT * FROM ev_gaps WHERE event_type = 'click' AND ts IS NOT NULL)
SELECT p.event_id, max_by(c.event_id, (c.ts, c.event_id)) AS click_id FROM p LEFT JOIN c
ON p.user_id IS NOT DISTINCT FROM c.user_id AND p.ts >= c.ts GROUP BY 1""")
def last_click_with_nulls(t):
    e = ev_gaps(t)
    bought = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    clicks = e.where(F.col("event_type") == "click").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return op.asof_join(bought, clicks, ["user_id"], "ts", "click_id", ["click_id"]).select("event_id", "click_id")


SCOPED = """scoped AS (SELECT net.*, s.owner AS src_owner, d.owner AS dst_owner FROM net
  LEFT JOIN owned s ON s.ip = srcaddr LEFT JOIN owned d ON d.ip = dstaddr)"""


@query("C10", sql(NET, OWNED, SCOPED) + """SELECT CASE WHEN src_owner IS NOT NULL AND dst_owner IS NOT NULL THEN 'east-west'
WHEN src_owner IS NOT NULL THEN 'outbound' WHEN dst_owner IS NOT NULL THEN 'inbound' ELSE 'external' END AS scope,
coalesce(src_owner, '-') AS src_owner, coalesce(dst_owner, '-') AS dst_owner, count(*) AS flows,
CAST(sum(bytes) AS BIGINT) AS bytes FROM scoped GROUP BY 1, 2, 3""")
def traffic_scope(t):
    return (op.traffic_scope(net(t), inventory(t)).fillna("-", ["src_owner", "dst_owner"])
            .groupBy("scope", "src_owner", "dst_owner").agg(F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes")))


@query("D43", sql(NET, OWNED, SCOPED) + """SELECT srcaddr, dstaddr, CAST(sum(bytes) AS BIGINT) AS total_bytes,
bool_or(dstport NOT IN (1, 2, 3, 4, 5, 6)) AS unexpected_port FROM scoped WHERE src_owner IS NOT NULL AND dst_owner IS NULL
GROUP BY 1, 2 HAVING sum(bytes) >= 15000000 OR bool_or(dstport NOT IN (1, 2, 3, 4, 5, 6))""")
def exfiltration_hints(t):
    return op.exfil_hints(net(t), inventory(t), 15000000, [1, 2, 3, 4, 5, 6])


@query("C11", """SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem
WHERE (l_suppkey, l_linenumber) NOT IN (SELECT s_suppkey, s_nationkey % 7 + 1 FROM supplier)""")
def topology_drift(t):
    expected = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 7 + 1).alias("l_linenumber"))
    return op.drift(t.lineitem, expected, ["l_suppkey", "l_linenumber"])


@query("C12", """WITH a AS (SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')),
b AS (SELECT event_id, value FROM events WHERE event_type IN ('click', 'error'))
SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN b.event_id IS NULL THEN 'edge' WHEN a.event_id IS NULL THEN 'app'
ELSE 'edge+app' END AS present_in FROM a FULL JOIN b ON a.event_id = b.event_id""")
def correlated_requests(t):
    edge = t.events.where(F.col("event_type").isin("view", "click")).select("event_id", "event_type")
    app = t.events.where(F.col("event_type").isin("click", "error")).select("event_id", "value")
    return op.correlate(edge, app, "event_id", ("edge", "app")).select("event_id", "present_in")


@query("C13", sql(EV) + """, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), c AS (SELECT * FROM ev WHERE event_type = 'click')
SELECT p.event_id, p.user_id, coalesce(c.event_id, -1) AS click_id FROM p ASOF LEFT JOIN c
ON p.user_id = c.user_id AND p.ts >= c.ts""")
def last_click_before_purchase(t):
    e = ev(t)
    bought = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    clicks = e.where(F.col("event_type") == "click").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return op.asof_join(bought, clicks, ["user_id"], "ts", "click_id", ["click_id"]).select(
        "event_id", "user_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"))


@query("C13", sql(EV) + """, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), c AS (SELECT * FROM ev WHERE event_type = 'click')
SELECT p.event_id, CASE WHEN epoch_us(p.ts) - epoch_us(c.ts) <= 7200000000 THEN c.event_id ELSE -1 END AS click_id
FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def recent_click_before_purchase(t):
    e = ev(t)
    bought = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    clicks = e.where(F.col("event_type") == "click").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return op.asof_join(bought, clicks, ["user_id"], "ts", "click_id", ["click_id"], 7200, 3600).select(
        "event_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"))


@query("C17", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN
(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)""")
def bloom_membership(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return op.bloom_prefilter(t.lineitem.select("l_orderkey", "l_linenumber"), urgent, "l_orderkey")


URGENT = "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000"


def _urgent(t):
    return t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")


@query("C17", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN ({URGENT})")
def stored_bloom_membership(t):
    # One filter per half of the time, stored, merged and put before the exact join.
    urgent, path = _urgent(t), work_path(t.spark, "bloom")
    blocks = membership.blocks_for(urgent.count(), 0.01)
    for name, half in (("early", F.year("o_orderdate") < 1995), ("late", F.year("o_orderdate") >= 1995)):
        membership.build(urgent.where(half), "l_orderkey", blocks).write.parquet(f"{path}/{name}")
    stored = membership.merge(*[t.spark.read.parquet(f"{path}/{name}") for name in ("early", "late")])
    return membership.member_rows(t.lineitem.select("l_orderkey", "l_linenumber"), urgent, "l_orderkey", stored)


@query("C17", f"""WITH members AS ({URGENT}), h AS (SELECT k, md5(CAST(k AS VARCHAR)) AS d FROM (SELECT o_orderkey AS k FROM members UNION SELECT l_orderkey FROM lineitem)),
bits AS (SELECT k, CAST('0x' || substr(d, 1, 12) AS BIGINT) % 16 AS block, w, (CAST('0x' || substr(d, 13, 12) AS BIGINT) >> CAST(6 * w AS INT)) % 64 AS bit
  FROM h, (SELECT unnest(range(8)) AS w)),
held AS (SELECT DISTINCT block, w, bit FROM bits WHERE k IN (FROM members)),
passed AS (SELECT k FROM bits JOIN held USING (block, w, bit) GROUP BY 1 HAVING count(*) = 8)
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (FROM passed)""")
def bloom_passed_rows(t):
    # Sixteen blocks, so that strangers pass and other engines can name them.
    stored = membership.build(_urgent(t), "l_orderkey", 16)
    return membership.might_contain(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey", stored)


@query("C17", f"""SELECT count(*) AS strangers, CAST(0 AS BIGINT) AS false_negatives, true AS within_rate
FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN ({URGENT}))""")
def bloom_quality(t):
    urgent = _urgent(t)
    stored = membership.build(urgent, "l_orderkey", membership.blocks_for(urgent.count(), 0.01))
    return membership.quality(t.lineitem, urgent, "l_orderkey", stored, 0.01)


@query("C18", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def not_yet_processed(t):
    seen = t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return op.new_only(t.orders.select("o_orderkey"), seen, "o_orderkey")


# Customers order, orders contain parts, parts come from suppliers; supplier n leads back to customer n (a cycle).
EDGES = """edges AS (SELECT 'C#' || o_custkey AS parent, 'O#' || o_orderkey AS child FROM orders
  UNION SELECT 'O#' || l_orderkey, 'P#' || l_partkey FROM lineitem
  UNION SELECT 'P#' || l_partkey, 'S#' || l_suppkey FROM lineitem
  UNION SELECT 'S#' || s_suppkey, 'C#' || s_suppkey FROM supplier)"""


def edges(t):
    tag = lambda kind, c: F.concat(F.lit(kind + "#"), F.col(c).cast("string"))
    rows = (t.orders.select(tag("C", "o_custkey").alias("parent"), tag("O", "o_orderkey").alias("child"))
            .union(t.lineitem.select(tag("O", "l_orderkey"), tag("P", "l_partkey")))
            .union(t.lineitem.select(tag("P", "l_partkey"), tag("S", "l_suppkey")))
            .union(t.supplier.select(tag("S", "s_suppkey"), tag("C", "s_suppkey"))))
    return rows.distinct()


@query("C14", sql(EDGES) + """SELECT child AS node FROM edges WHERE parent = 'C#5' UNION SELECT parent FROM edges WHERE child = 'C#5'""")
def graph_neighbours(t):
    return graph.neighbours(edges(t), "C#5", "both")


@query("C15", sql(EDGES, """walk(node, hops) AS (SELECT 'C#5', 0 UNION SELECT child, hops + 1 FROM walk JOIN edges ON parent = node WHERE hops < 5)""",
                  recursive=True) + "SELECT node, CAST(min(hops) AS INT) AS hops FROM walk GROUP BY 1")
def graph_reach(t):
    roots = t.customer.where("c_custkey = 5").select(F.concat(F.lit("C#"), F.col("c_custkey").cast("string")).alias("node"))
    # The derived edges are read once per level: store them first.
    return graph.reach(cut_lineage(edges(t)), roots, 5)


@query("C16", """SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def subtree_by_path(t):
    tree = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_name", F.concat_ws("#", F.lit("WORLD"), "r_name", "n_name").alias("path"))
    return graph.subtree(tree, "path", "WORLD#ASIA").select("n_name")
