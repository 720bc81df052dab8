"""Registered queries: event-time windows, event logs, delivery and stream runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators.limits import anchored_fold
from opsloom.operators.ranking import latest_by
from opsloom.plans.changes import ANCHORS
from opsloom.plans.ranking import stream_entries, unique_entries
from opsloom.plans.registry import query
from opsloom.plans.roles import EV, PRODUCTS, WEB, ev, products, sql, web
from opsloom.session import work_path
from opsloom.streaming import entries, log, runner, stateful, windows as win


@query("J1", sql(EV) + "SELECT event_id FROM ev WHERE value > 10")
def filtered_stream(t):
    return win.stream_filter(ev(t), F.col("value") > 10).select("event_id")


TUMBLING = """SELECT date_trunc('minute', ts) AS start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS "end", count(*) AS n FROM events GROUP BY 1, 2"""


@query("J2", TUMBLING)
def tumbling_minute(t):
    return win.tumbling(t.events, "ts", "1 minute")


SLIDING = """WITH s AS (SELECT make_timestamp((epoch_us(ts) // 3600000000 - i) * 3600000000) AS start, event_type FROM events, (SELECT unnest([0, 1, 2]) AS i))
SELECT start, start + INTERVAL 3 HOUR AS "end", event_type, count(*) AS n FROM s GROUP BY 1, 2, 3"""


@query("J3", SLIDING)
def sliding_three_hours(t):
    return win.sliding(t.events, "ts", "3 hours", "1 hour", ["event_type"])


SESSIONS = """WITH l AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM l)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, sid"""


@query("J4", SESSIONS)
def user_sessions(t):
    return win.sessions(t.events, "user_id", "ts", "event_id", 21600)


@query("J7", sql(EV) + "SELECT event_id, CAST(value AS DOUBLE) AS value FROM ev WHERE value > 30")
def threshold_alerts(t):
    return win.alerts(ev(t), "value", 30).select("event_id", "value")


AVERAGE = sql(EV) + """SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", event_type,
CAST(sum(value) AS DOUBLE) / count(*) AS average, count(*) AS samples FROM ev GROUP BY 1, 2, 3"""


@query("J8", AVERAGE)
def sensor_average(t):
    return win.sensor_average(ev(t), "ts", "event_type", "value", "1 day")


@query("J9", sql(WEB) + """, c AS (SELECT date_trunc('day', ts) AS start, path, count(*) AS views FROM web GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY start ORDER BY views DESC, path) AS INT) AS rank FROM c)
SELECT start, start + INTERVAL 1 DAY AS "end", path, views, rank FROM r WHERE rank <= 5""")
def popular_pages(t):
    return win.popular_pages(web(t), "ts", "path", "1 day", 5)


@query("J27", sql(EV) + """SELECT date_trunc('minute', ts) AS start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS "end",
CAST(max(value) AS DOUBLE) AS value FROM ev GROUP BY 1, 2""")
def downsampled_max(t):
    return win.downsample(ev(t), "ts", "value", "1 minute", "max")


@query("J28", sql(EV) + """SELECT event_id FROM ev WHERE event_type = 'view' AND user_id % 3 <> 1
AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'""")
def series_range(t):
    labelled = ev(t).withColumn("labels", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("host"), (F.col("user_id") % 3).cast("string")))
    return win.ts_range(labelled, "ts", "2024-01-05", "2024-01-09", "kind=view,host!=1").select("event_id")


@query("J29", sql(EV) + """SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM ev
WHERE event_type = 'error' AND k > 20 GROUP BY 1, 2""")
def log_metric(t):
    lines = ev(t).withColumn("message", F.to_json(F.struct(F.col("event_type").alias("level"), "k")))
    return win.log_metric(lines, "ts", "message", '{ $.level = "error" && $.k > 20 }', "1 hour")


@query("J25", "SELECT event_id, event_type, 'none' AS channel FROM events")
def evolved_schema(t):
    known = {"event_id": F.lit(0), "event_type": F.lit("?"), "channel": F.lit("none")}
    return win.evolve(t.events, known)


@query("J24", sql(EV, PRODUCTS) + """SELECT event_id, upper(event_type) AS event_type, sha256(CAST(user_id AS VARCHAR)) AS visitor,
coalesce(name, '') AS name FROM ev LEFT JOIN products ON id = k WHERE k IS NOT NULL""")
def transformed_records(t):
    clean = {"event_type": F.upper("event_type"), "visitor": F.sha2(F.col("user_id").cast("string"), 256), "id": F.col("k").cast("bigint")}
    rows = win.transform(ev(t), clean, ["k"], products(t).select("id", "name"), "id")
    return rows.select("event_id", "event_type", "visitor", F.coalesce("name", F.lit("")).alias("name"))


# --- event log --------------------------------------------------------------------------------

@query("J10 J11", """SELECT event_id FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)
WHERE ms >= 1704844800000 AND (ms < 1704931200000 OR (ms = 1704931200000 AND event_id <= 1)) ORDER BY ms, event_id LIMIT 100""")
def range_of_entries(t):
    return log.range_read(unique_entries(t), "id", "1704844800000-0", "1704931200000-1", 100).select("event_id")


@query("J12", "SELECT event_id FROM events WHERE epoch_us(ts) // 1000 * 10 + event_id % 3 > 17050000000001")
def entries_since(t):
    return log.since(stream_entries(t), "id", "1705000000000-1").select("event_id")


@query("J14", """SELECT count(*) AS length, arg_min(epoch_us(ts) // 1000 || '-' || event_id % 3, event_id) AS first_id,
arg_max(epoch_us(ts) // 1000 || '-' || event_id % 3, event_id) AS last_id FROM events""")
def log_info(t):
    return log.stream_info(stream_entries(t), "id")


@query("J13", """SELECT event_id, user_id % 3 AS grp FROM events WHERE event_type <> 'click'""")
def pending_entries(t):
    grp = t.events.select("event_id", (F.col("user_id") % 3).alias("grp"), "event_type")
    return log.pending(grp, grp.where(F.col("event_type") == "click"), ["grp", "event_id"]).select("event_id", "grp")


@query("J13", "SELECT event_id FROM events WHERE event_type <> 'click' AND ts < TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR")
def claimable_entries(t):
    rows = log.pending(t.events, t.events.where(F.col("event_type") == "click"), ["event_id"])
    return log.claimable(rows, "ts", "2024-01-31", 36 * 3600).select("event_id")


LAG = """ends AS (SELECT user_id % 4 AS grp, user_id AS part, max(event_id) AS latest FROM events GROUP BY 1, 2),
done AS (SELECT user_id % 4 AS grp, user_id AS part, max(event_id) AS committed FROM events WHERE event_type = 'view' AND value > 120 GROUP BY 1, 2),
lags AS (SELECT e.grp, e.part, latest - coalesce(committed, 0) AS lag FROM ends e LEFT JOIN done d ON e.grp = d.grp AND e.part = d.part)"""


def _lags(t):
    parts = t.events.select((F.col("user_id") % 4).alias("grp"), F.col("user_id").alias("part"), "event_id", "event_type", "value")
    ends = parts.groupBy("grp", "part").agg(F.max("event_id").alias("latest"))
    done = parts.where("event_type = 'view' AND value > 120").groupBy("grp", "part").agg(F.max("event_id").alias("committed"))
    return log.lag(ends, done, ["grp", "part"])


@query("J15", sql(LAG) + "SELECT grp, part, lag FROM lags")
def partition_lag(t):
    return _lags(t)


@query("J15", sql(LAG) + "SELECT grp, CAST(sum(lag) AS BIGINT) AS lag FROM lags GROUP BY 1")
def group_lag(t):
    return log.total_lag(_lags(t), "grp")


@query("J16", """WITH b AS (SELECT event_type, min(event_id) AS lo, max(event_id) AS hi, max(event_id) FILTER (user_id < 100) AS committed FROM events GROUP BY 1)
SELECT event_id FROM events JOIN b USING (event_type) WHERE event_id >= least(greatest(committed - 500, lo), hi + 1)""")
def replay_shifted(t):
    committed = t.events.where("user_id < 100").groupBy("event_type").agg(F.max("event_id").alias("committed"))
    return log.replay_from(t.events, {"shift": -500}, "event_type", "event_id", "ts", committed).select("event_id")


@query("J16", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-22 12:00:00'")
def replay_from_time(t):
    return log.replay_from(t.events, {"datetime": "2024-01-22 12:00:00"}, "event_type", "event_id", "ts").select("event_id")


def _bodies(t):
    body = F.to_json(F.struct(F.when(F.col("k") % 9 != 0, F.col("user_id")).alias("user_id"), "event_type"))
    return ev(t).select("event_id", F.when(F.col("event_id") % 30 == 5, F.substring(body, 1, 12)).otherwise(body).alias("body"))


@query("J17", sql(EV) + "SELECT event_id, user_id, event_type FROM ev WHERE event_id % 30 <> 5 AND k % 9 <> 0")
def decoded_records(t):
    return log.good_and_bad(_bodies(t), "body", "user_id bigint, event_type string", ["user_id", "event_type"], ["event_id"])[0]


@query("J17", sql(EV) + """SELECT event_id, CASE WHEN event_id % 30 = 5 THEN 'undecodable' ELSE 'missing user_id' END AS error FROM ev
WHERE event_id % 30 = 5 OR k % 9 = 0""")
def dead_letters(t):
    bad = log.good_and_bad(_bodies(t), "body", "user_id bigint, event_type string", ["user_id", "event_type"], ["event_id"])[1]
    return bad.select("event_id", "error")


@query("J18", """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS fails FROM orders GROUP BY 1
HAVING count(*) FILTER (o_orderstatus = 'F') >= 5 AND count(*) FILTER (o_orderstatus = 'P') = 0""")
def redriven_messages(t):
    attempts = t.orders.where("o_orderstatus IN ('F', 'P')")
    return log.redrive(attempts, "o_custkey", F.col("o_orderstatus") == "F", 5)[0]


@query("J19", sql("""a AS (SELECT user_id, event_type, min(ts) AS anchor FROM events GROUP BY 1, 2
  UNION ALL SELECT user_id, event_type, nxt FROM (SELECT a.user_id, a.event_type, (SELECT min(ts) FROM events e WHERE e.user_id = a.user_id
    AND e.event_type = a.event_type AND e.ts >= a.anchor + INTERVAL 1 DAY) AS nxt FROM a) WHERE nxt IS NOT NULL)""", recursive=True) +
       "SELECT event_id FROM events JOIN a ON a.user_id = events.user_id AND a.event_type = events.event_type AND anchor = ts")
def deduplicated_messages(t):
    body = t.events.withColumn("content", log.content_id(F.concat_ws("/", F.col("user_id").cast("string"), "event_type")))
    return log.dedup(body, "content", "ts", "event_id", 86400).select("event_id")


@query("J22", "SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'unknown' END AS route FROM events")
def routed_events(t):
    return log.route_events(t.events, "event_type", ["view", "click", "purchase"]).select("event_id", "route")


ROUTES = {"sales": {"event_type": ["purchase"]}, "large": {"value": [{"numeric": [">", 30]}]}, "audit": {"event_type": [{"anything-but": "view"}]}}
FAN_OUT = sql(EV) + """SELECT event_id, 'sales' AS subscription FROM ev WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'large' FROM ev WHERE value > 30 UNION ALL SELECT event_id, 'audit' FROM ev WHERE event_type <> 'view'"""


@query("J21", FAN_OUT)
def fanned_out_events(t):
    return log.fan_out(ev(t), ROUTES).select("event_id", "subscription")


@query("J26", "SELECT conv_id, turn, role || ': ' || text AS reply FROM conversations")
def echoed_messages(t):
    return log.echo(t.conversations, "role", "text").select("conv_id", "turn", "reply")


@query("J26", """SELECT conv_id, count(*) AS n, count(*) || ' requests received' AS reply FROM conversations GROUP BY 1""")
def collected_requests(t):
    return log.collect_requests(t.conversations, "conv_id")


@query("T10", sql(EV) + """SELECT event_id FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-12' AND event_type IN ('click', 'signup')""")
def replayed_archive(t):
    return log.replay_archive(ev(t), "ts", "2024-01-08", "2024-01-12", {"event_type": ["click", "signup"]}).select("event_id")


@query("T11", """SELECT event_id, c_name, c_mktsegment FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'""")
def enriched_pipe(t):
    dim = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return log.pipe(t.events, {"event_type": ["purchase"]}, dim, "user_id").select("event_id", "c_name", "c_mktsegment")


# --- real stream runs over the events file; their SQL is that of the batch form -----------------

def _stream(t, max_files=None):
    return runner.file_stream(t.spark, f"{t.path}/events.parquet", max_files=max_files)


@query("A9 J1 J7", "SELECT event_id FROM events WHERE value > 10")
def run_filter_stream(t):
    return runner.run_to_files(win.stream_filter(_stream(t), F.col("value") > 10).select("event_id"), "filter", t.spark)


@query("J2 J5", TUMBLING)
def run_tumbling_stream(t):
    timed = win.with_event_time(_stream(t), "ts", "10 minutes")
    counts = win.tumbling(timed, "ts", "1 minute")
    return runner.run_updates(counts, "tumbling", t.spark, ["start", "end"])


# Events arrive in three micro-batches of half a month each; some of them one batch late. A last heartbeat ends all state.
HALF, LATE_BY = 15, 7
ARRIVALS = f"""a AS (SELECT *, epoch_us(ts) AS us, (day(ts) - 1) // {HALF} + CASE WHEN event_id % {LATE_BY} = 3 THEN 1 ELSE 0 END AS slot FROM events),
tops AS (SELECT slot, max(us) // 1000 AS top FROM a GROUP BY 1)"""


def _marks(days):
    """SQL: the watermark (us) when each micro-batch begins."""
    return f"marks AS (SELECT s.slot, (max(m.top) - {days * 86400000}) * 1000 AS mark FROM tops s LEFT JOIN tops m ON m.slot < s.slot GROUP BY 1)"


def _arrivals(t):
    slot = F.floor((F.dayofmonth("ts") - 1) / HALF) + F.when(F.col("event_id") % LATE_BY == 3, 1).otherwise(0)
    return [t.events.where(slot == n) for n in range(3)] + [stateful.heartbeat(t.events, "ts", 90 * 86400)]


@query("J5 J2", sql(ARRIVALS, _marks(3), """j AS (SELECT a.*, (us // 86400000000 + 1) * 86400000000 <= mark AS late FROM a JOIN marks USING (slot))""") + """
SELECT event_type, 'late' AS kind, NULL AS start, NULL AS "end", NULL AS n, event_id FROM j WHERE late
UNION ALL SELECT event_type, 'window', date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 1 DAY, count(*), NULL FROM j WHERE late IS NOT true GROUP BY 1, 3""")
def run_windows_and_late(t):
    build = lambda s: stateful.windows_and_late(s, "ts", 86400, "event_type", "event_id", "3 days")
    return stateful.run_arrivals(t.spark, _arrivals(t), build, "windows")


@query("J4 J5", sql(ARRIVALS, _marks(3), """j AS (SELECT a.*, us + 21600000000 <= mark AS late FROM a JOIN marks USING (slot))""",
                    """l AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 21600000000 THEN 0 ELSE 1 END AS opens FROM j WHERE late IS NOT true)""",
                    """s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id) AS sid FROM l)""") + """
SELECT user_id, 'late' AS kind, NULL AS start, NULL AS "end", NULL AS n, event_id FROM j WHERE late
UNION ALL SELECT user_id, 'session', min(ts), max(ts) + INTERVAL 6 HOUR, count(*), NULL FROM s GROUP BY user_id, sid""")
def run_sessions_and_late(t):
    build = lambda s: stateful.sessions_and_late(s, "ts", 21600, "user_id", "event_id", "3 days")
    return stateful.run_arrivals(t.spark, _arrivals(t), build, "sessions-late")


@query("J4 J5", SESSIONS)
def run_session_stream(t):
    # No event is later than the watermark's delay, so the stream finds the sessions of the whole table.
    build = lambda s: stateful.sessions_and_late(s, "ts", 21600, "user_id", "event_id", "31 days")
    return stateful.run_arrivals(t.spark, _arrivals(t), build, "sessions").select("start", "end", "user_id", "n")


@query("J6", "SELECT user_id, event_type, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS BIGINT) AS quantity FROM events GROUP BY 1, 2")
def run_cart_state_stream(t):
    carts = _stream(t).withColumn("delta", F.when(F.col("event_type") == "error", -1).otherwise(1))
    return runner.run_updates(win.cart_stream(carts, ["user_id", "event_type"], "delta"), "carts", t.spark, ["user_id", "event_type"])


@query("J20", """SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1""")
def run_upsert_stream(t):
    path = work_path(t.spark, "upsert")
    source = _stream(t).select("user_id", "event_id")
    runner.run_to_batches(source, "upsert", t.spark, "append", runner.upsert_latest(path, "user_id", "event_id", t.spark))
    return latest_by(t.spark.read.schema(source.schema).parquet(f"{path}/v*"), ["user_id"], ["event_id"])


@query("J21", FAN_OUT)
def run_fan_out_stream(t):
    base = work_path(t.spark, "fan-out")
    source = log.fan_out(_stream(t), ROUTES).select("event_id", "subscription")
    runner.run_to_batches(source, "fan-out", t.spark, "append", runner.fan_out_sinks(base, "subscription"))
    return t.spark.read.schema(source.schema).parquet(base).select("event_id", "subscription")


@query("J17", sql(EV) + "SELECT event_id, CASE WHEN event_id % 30 = 5 THEN 'undecodable' ELSE 'missing user_id' END AS error FROM ev WHERE event_id % 30 = 5 OR k % 9 = 0")
def run_dead_letter_stream(t):
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.to_json(F.struct(F.when(k % 9 != 0, F.col("user_id")).alias("user_id"), "event_type"))
    raw = _stream(t).select("event_id", F.when(F.col("event_id") % 30 == 5, F.substring(body, 1, 12)).otherwise(body).alias("body"))
    bad = log.good_and_bad(raw, "body", "user_id bigint, event_type string", ["user_id", "event_type"], ["event_id"])[1]
    return runner.run_to_files(bad.select("event_id", "error"), "dead-letters", t.spark)


CONTENT = "c AS (SELECT event_id, ts, user_id || '/' || event_type AS content FROM events)"
CONTENT_ANCHORS = """ca AS (SELECT content, min(ts) AS anchor FROM c GROUP BY 1
  UNION ALL SELECT content, nxt FROM (SELECT ca.content, (SELECT min(ts) FROM c WHERE c.content = ca.content AND c.ts >= ca.anchor + INTERVAL 2 DAY) AS nxt FROM ca) WHERE nxt IS NOT NULL)"""


@query("J19", sql(CONTENT, CONTENT_ANCHORS, recursive=True) + """SELECT content, event_id FROM (SELECT c.content, event_id,
row_number() OVER (PARTITION BY c.content, anchor ORDER BY c.ts, event_id) AS rn FROM c ASOF JOIN ca ON c.content = ca.content AND c.ts >= ca.anchor) WHERE rn = 1""")
def run_dedup_stream(t):
    # The first message of a content opens an interval of two days; later ones in it are dropped.
    keyed = [f.withColumn("content", F.concat_ws("/", F.col("user_id").cast("string"), "event_type")) for f in _arrivals(t)]
    build = lambda s: stateful.limiter_by_time(s, "ts", "content", "event_id", anchored_fold(1, 2 * 86400 * 1_000_000), 2 * 86400, "16 days")
    return stateful.run_arrivals(t.spark, keyed, build, "dedup").where("allowed").select("content", "event_id")


@query("E21", sql(ANCHORS, recursive=True) + """SELECT user_id, event_id, rn <= 2 AS allowed FROM (SELECT e.user_id, event_id,
row_number() OVER (PARTITION BY e.user_id, anchor ORDER BY e.ts, event_id) AS rn FROM events e ASOF JOIN a ON e.user_id = a.user_id AND e.ts >= a.anchor)""")
def run_limiter_stream(t):
    # Events come up to 15 days late; the watermark waits for 16.
    build = lambda s: stateful.limiter_by_time(s, "ts", "user_id", "event_id", anchored_fold(2, 86400 * 1_000_000), 86400, "16 days")
    return stateful.run_arrivals(t.spark, _arrivals(t), build, "limiter").select("user_id", "event_id", "allowed")


@query("E21 J5", sql(
    ARRIVALS, _marks(3), "j AS (SELECT a.*, (us + 999) // 1000 * 1000 <= mark AS late FROM a JOIN marks USING (slot))",
    "fine AS (SELECT * FROM j WHERE late IS NOT true)", """an AS (SELECT user_id, min(ts) AS anchor FROM fine GROUP BY 1
  UNION ALL SELECT user_id, nxt FROM (SELECT an.user_id, (SELECT min(ts) FROM fine e WHERE e.user_id = an.user_id AND e.ts >= an.anchor + INTERVAL 1 DAY) AS nxt FROM an) WHERE nxt IS NOT NULL)""",
    recursive=True) + """
SELECT user_id, 'late' AS kind, event_id, NULL AS allowed FROM j WHERE late
UNION ALL SELECT user_id, 'decided', event_id, rn <= 2 FROM (SELECT e.user_id, event_id,
row_number() OVER (PARTITION BY e.user_id, anchor ORDER BY e.ts, event_id) AS rn FROM fine e ASOF JOIN an ON e.user_id = an.user_id AND e.ts >= an.anchor)""")
def run_limiter_and_late(t):
    build = lambda s: stateful.limiter_by_time(s, "ts", "user_id", "event_id", anchored_fold(2, 86400 * 1_000_000), 86400, "3 days")
    return stateful.run_arrivals(t.spark, _arrivals(t), build, "limiter-late")


@query("J23", "SELECT o_orderkey, o_totalprice FROM orders")
def run_buffered_delivery(t):
    # Four input files, two per micro-batch; each batch becomes one replaceable output folder.
    base, inbox = work_path(t.spark, "delivered"), work_path(t.spark, "inbox")
    t.orders.select("o_orderkey", "o_totalprice").repartition(4, "o_orderkey").write.parquet(inbox)
    source = runner.file_stream(t.spark, inbox, max_files=2)
    runner.run_to_batches(source, "delivery", t.spark, "append", runner.write_idempotent(base))
    return t.spark.read.schema(source.schema).parquet(f"{base}/batch=*")


FLUSH_BYTES, FLUSH_HOURS = 40, 48
BUFFERS = f"""r AS (SELECT user_id, event_id, epoch_us(ts) AS us, props, strlen(props) AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, rn, us AS first, size AS held, 0 AS flush FROM r WHERE rn = 1
  UNION ALL SELECT r.user_id, r.rn, CASE WHEN held >= {FLUSH_BYTES} OR r.us >= first + {FLUSH_HOURS * 3600000000} THEN r.us ELSE first END,
    CASE WHEN held >= {FLUSH_BYTES} OR r.us >= first + {FLUSH_HOURS * 3600000000} THEN r.size ELSE held + r.size END,
    CASE WHEN held >= {FLUSH_BYTES} OR r.us >= first + {FLUSH_HOURS * 3600000000} THEN flush + 1 ELSE flush END
  FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)"""


@query("J23", sql(BUFFERS, recursive=True) + f"""SELECT user_id, CAST(flush AS BIGINT) AS flush, CASE WHEN sum(size) >= {FLUSH_BYTES} THEN 'size' ELSE 'time' END AS reason,
count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, sha256(string_agg(props, chr(10) ORDER BY rn)) AS body_sha256 FROM f JOIN r USING (user_id, rn) GROUP BY user_id, flush""")
def run_flushes_by_size_or_time(t):
    # Each user's bodies leave together, at 40 bytes or 48 hours after the first one, in three arrivals and a heartbeat.
    frames = [t.events.where(F.floor((F.dayofmonth("ts") - 1) / HALF) == n) for n in range(3)] + [stateful.heartbeat(t.events, "ts", 90 * 86400)]
    build = lambda s: stateful.buffered_delivery(s, "user_id", "event_id", F.col("props"), FLUSH_BYTES, FLUSH_HOURS * 3600, "ts")
    objects = stateful.run_arrivals(t.spark, frames, build, "flushes")
    return objects.select("user_id", "flush", "reason", "n", "bytes", F.sha2("body", 256).alias("body_sha256"))


@query("J10 J11", """WITH e AS (SELECT event_type, event_id, epoch_us(ts) // 3600000000 * 3600000 AS ms, event_id % 3 AS batch FROM events),
tops AS (SELECT event_type, batch, max(ms) AS top FROM e GROUP BY 1, 2),
w AS (SELECT event_type, batch, max(top) OVER (PARTITION BY event_type ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tops),
g AS (SELECT e.*, greatest(ms, coalesce(before, 0)) AS eff FROM e JOIN w USING (event_type, batch))
SELECT event_type, event_id, eff || '-' || (row_number() OVER (PARTITION BY event_type, eff ORDER BY batch, ms, event_id) - 1) AS entry_id FROM g""")
def run_append_entries(t):
    # Three micro-batches, each with times from the whole month: most entries come behind the stream's last id. Every batch is sent twice.
    target, inbox = work_path(t.spark, "entries"), work_path(t.spark, "entries-inbox")
    rows = t.events.select("event_type", "event_id", F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("ms"))
    for n in range(3):
        rows.where(F.col("event_id") % 3 == n).coalesce(1).write.mode("append").parquet(inbox)
    found = entries.EntryLog(t.spark, target, "event_type", "ms", "event_id")

    def twice(df, batch):
        found.append(df, batch)
        found.append(df, batch)

    runner.run_to_batches(runner.file_stream(t.spark, inbox, max_files=1), "entries", t.spark, "append", twice)
    return found.read().select("event_type", "event_id", "entry_id")
