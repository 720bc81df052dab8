"""Worked examples with known results."""

import datetime

from pyspark.sql import functions as F

from opsloom.functions import patterns, scalars
from opsloom.functions.ordered import slots
from opsloom.operators import aggregates, changes, filters, limits, metrics, ranking, sets, traces
from opsloom.streaming import log


def ts(text):
    return datetime.datetime.fromisoformat(text)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_metric_statistics(spark):
    df = frame(spark, [(ts("2024-01-01 00:00:00"), v) for v in (20, 40, 60)], "ts timestamp_ntz, value int")
    row = metrics.metric_stats(df, "value", 60, []).first()
    assert (row["average"], row["minimum"], row["maximum"], row["sample_count"]) == (40.0, 20, 60, 3)
    load = frame(spark, [(ts("2024-01-01 00:00:00"), v) for v in (100, 120, 80)], "ts timestamp_ntz, value int")
    assert metrics.metric_stats(load, "value", 60, []).first()["sum"] == 300


def test_alarm_states(spark):
    rows = [("cpu", ts("2024-01-01 00:00:00"), 35.0), ("cpu", ts("2024-01-01 00:01:00"), 92.0)]
    df = metrics.alarm(frame(spark, rows, "m string, period timestamp_ntz, v double"), ["m"], "period", "v", 60, 80.0, 1, 1)
    assert [r["state"] for r in df.orderBy("period").collect()] == ["OK", "ALARM"]


def test_alarm_with_missing_period(spark):
    rows = [("cpu", ts("2024-01-01 00:00:00"), 90.0), ("cpu", ts("2024-01-01 00:02:00"), 10.0), ("cpu", ts("2024-01-01 00:03:00"), 10.0)]
    df = metrics.alarm(frame(spark, rows, "m string, period timestamp_ntz, v double"), ["m"], "period", "v", 60, 80.0, 2, 2)
    assert [r["state"] for r in df.orderBy("period").collect()] == ["INSUFFICIENT_DATA", "INSUFFICIENT_DATA", "INSUFFICIENT_DATA", "OK"]


def test_consumer_lag(spark):
    ends = frame(spark, [("g", 0, 500), ("g", 1, 800)], "grp string, part int, latest long")
    done = frame(spark, [("g", 0, 495), ("g", 1, 760)], "grp string, part int, committed long")
    lags = log.lag(ends, done, ["grp", "part"])
    assert values(lags, "lag") == [(5,), (40,)]
    assert log.total_lag(lags, "grp").first()["lag"] == 45


def test_replay_without_commit_is_full_backlog(spark):
    ends = frame(spark, [("g", 0, 500)], "grp string, part int, latest long")
    none = frame(spark, [], "grp string, part int, committed long")
    assert log.lag(ends, none, ["grp", "part"]).first()["lag"] == 500


def test_event_replay(spark):
    df = frame(spark, [("a", i, v) for i, v in enumerate((100, 50, -25, 80, -10))], "k string, seq long, v long")
    assert ranking.replay_final(df, "k", "v").first()["balance"] == 195
    running = ranking.replay(df, "k", ["seq"], "v", slots("seq", 2))
    assert [r["balance"] for r in running.orderBy("seq").collect()] == [100, 150, 125, 205, 195]


def test_compaction_keeps_last_and_drops_tombstones(spark):
    rows = [("p", i, q) for i, q in enumerate(("100", "95", "90", "75"))] + [("gone", 9, "1"), ("gone", 10, None), (None, 11, "x")]
    df = frame(spark, rows, "k string, offset long, value string")
    assert values(changes.compact(df, "k", "offset", "value"), "k", "value") == [("p", "75")]


def test_key_partition_modulo(spark):
    assert 456987 % 4 == 3
    from opsloom.functions.hashing import key_partition
    df = spark.range(1000).select(key_partition("id", 4).alias("p"))
    counts = {r["p"]: r["count"] for r in df.groupBy("p").count().collect()}
    assert set(counts) == {0, 1, 2, 3} and min(counts.values()) > 150


def test_set_algebra(spark):
    a = frame(spark, [(x,) for x in ("Alice", "Bob", "Charlie")], "m string")
    b = frame(spark, [(x,) for x in ("Bob", "Charlie", "David")], "m string")
    assert values(sets.sinter(a, b)) == [("Bob",), ("Charlie",)]
    assert values(sets.sdiff(a, b)) == [("Alice",)]
    assert len(values(sets.sunion(a, b))) == 4


def test_common_interests(spark):
    rows = [("x", m) for m in ("Python", "Redis", "AWS")] + [("y", m) for m in ("Redis", "Docker", "AWS")]
    assert values(sets.common(frame(spark, rows, "k string, m string"), "k", "m", "x", "y")) == [("AWS",), ("Redis",)]


def test_sorted_set(spark):
    z = frame(spark, [("Alice", 100), ("Bob", 250), ("David", 400)], "member string, score long")
    assert [r["member"] for r in ranking.zrange(z, 0, 2).collect()] == ["Alice", "Bob", "David"]
    assert [r["member"] for r in ranking.zrange(z, 0, 2, reverse=True).collect()] == ["David", "Bob", "Alice"]
    assert ranking.zrank(z, "Bob").first()["rank"] == 1
    assert ranking.zrank(z, "Nobody").collect() == []
    assert values(ranking.zrange(z, -2, -1), "member") == [("Bob",), ("David",)]
    events = frame(spark, [("Bob", 250, 1), ("Bob", 50, 2)], "m string, s long, t int")
    assert ranking.zset_from_events(events, "m", "s", ["t"]).first()["score"] == 300
    scores = frame(spark, [("John", 300), ("Bob", 250), ("Zed", 900)], "member string, score long")
    assert [r["member"] for r in ranking.zrange_by_score(scores, 200, 400).collect()] == ["Bob", "John"]


def test_leaderboard_breaks_ties_by_member_descending(spark):
    z = frame(spark, [("10", 5), ("9", 5), ("1", 7)], "member string, score long")
    assert [(r["member"], r["rank"]) for r in ranking.leaderboard(z, 3).collect()] == [("1", 1), ("9", 2), ("10", 3)]


def test_page_tokens(spark):
    df = spark.range(10)
    first = ranking.page_after(df, "id", None, 4).collect()
    assert [r["id"] for r in first] == [0, 1, 2, 3] and {r["next_token"] for r in first} == {"3"}
    last = ranking.page_after(df, "id", 7, 4).collect()
    assert [r["id"] for r in last] == [8, 9] and {r["next_token"] for r in last} == {None}


def test_prefix_policy(spark):
    df = frame(spark, [("us-east-1",), ("us-west-2",), ("eu-west-1",)], "Region string")
    assert values(filters.match_policy(df, {"Region": [{"prefix": "us-"}]})) == [("us-east-1",), ("us-west-2",)]
    assert filters.match_policy(df, {"Zone": [{"exists": False}]}).count() == 3
    assert filters.match_policy(df, {"Zone": ["a"]}).count() == 0


def test_label_selectors(spark):
    rows = [("a", {"app": "web", "env": "prod"}), ("b", {"app": "db"}), ("c", {})]
    df = frame(spark, rows, "n string, labels map<string,string>")
    pick = lambda s: [r["n"] for r in filters.select_labels(df, s).orderBy("n").collect()]
    assert pick("app=web") == ["a"]
    assert pick("app!=web") == ["b", "c"]
    assert pick("app in (web, db),env") == ["a"]
    assert pick("env notin (prod)") == ["b", "c"]
    assert pick("!app") == ["c"]


def test_metric_filter_patterns(spark):
    df = frame(spark, [('{"status": 500, "service": "payment"}',), ("127.0.0.1 GET /login 500",), ("ERROR Exception Timeout",)], "message string")
    count = lambda p: filters.metric_filter(df, p).count()
    assert count("{ $.status = 500 }") == 1
    assert count("[ip, method, path, status = 500]") == 1
    assert count("ERROR Timeout") == 1
    assert count("ERROR Missing") == 0


def test_fixed_window_boundary_burst(spark):
    rows = [("c", ts("2024-01-01 12:00:59"), i) for i in range(100)] + [("c", ts("2024-01-01 12:01:00"), 100 + i) for i in range(100)]
    df = limits.rate_fixed(frame(spark, rows, "k string, ts timestamp_ntz, id long"), "k", "ts", "id", 100, 60)
    assert df.where("allowed").count() == 200


def test_reservoir_sampling(spark):
    df = spark.range(1000).select("id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    n = filters.reservoir_sample(df, "ts", "id", 1, 5).count()
    assert 20 <= n <= 90


def test_trace_bottleneck(spark):
    rows = [(1, n, name, 0, ms, 200) for n, (name, ms) in enumerate([("gateway", 15), ("function", 120), ("table", 35), ("external", 420)])]
    df = frame(spark, rows, "trace_id long, segment_id long, service string, start_ms long, end_ms long, status int")
    assert traces.bottleneck(df).first()["service"] == "external"


def test_hit_rate(spark):
    df = spark.range(20).select(F.when(F.col("id") < 17, "HIT").otherwise("MISS").alias("cache"), F.lit("GET").alias("method"), F.lit(200).alias("status"))
    assert metrics.cache_hit_rate(df).first()["hit_rate"] == 85.0


def test_partition_estimate(spark):
    df = frame(spark, [(ts("2024-01-01 00:00:00"), 200)], "ts timestamp_ntz, mb long")
    assert aggregates.capacity(df, 1, "mb", 20).first()["partitions"] == 10


def test_sketch_error_stays_small(spark):
    df = spark.range(200_000).select((F.col("id") % 50_000).alias("u"))
    estimate = metrics.unique_visitors(df, "u").first()["uniques"]
    assert abs(estimate - 50_000) <= 0.03 * 50_000


def test_strings(spark):
    row = frame(spark, [("Hello World",)], "s string").select(
        scalars.getrange("s", 0, 4).alias("a"), scalars.getrange("s", -5, -1).alias("b"), scalars.setrange("s", 6, "Redis").alias("c")).first()
    assert tuple(row) == ("Hello", "World", "Hello Redis")
    assert frame(spark, [("ab",)], "s string").select(scalars.setrange("s", 4, "x")).first()[0] == "ab\0\0x"


def test_client_ip_order(spark):
    rows = [("1.1.1.1, 2.2.2.2", "3.3.3.3", "4.4.4.4"), ("", "3.3.3.3", "4.4.4.4"), (None, "", "4.4.4.4"), (None, None, None)]
    df = frame(spark, rows, "x string, r string, p string").select(scalars.client_ip("x", "r", "p").alias("ip"))
    assert [r["ip"] for r in df.collect()] == ["1.1.1.1", "3.3.3.3", "4.4.4.4", "unknown"]


def test_globs():
    import re
    assert re.match(patterns.glob_regex("products:*"), "products:1") and not re.match(patterns.glob_regex("products:*"), "product:1")
    assert re.match(patterns.glob_capture("user * did *"), "user 7 did click").groups() == ("7", "click")


def test_patch_missing_differs_from_null(spark):
    base = frame(spark, [(1, "a", "x"), (2, "b", "y")], "id int, n string, c string")
    change = frame(spark, [(1, {"c": None}), (2, {"n": "z"})], "id int, fields map<string,string>")
    assert sorted(map(tuple, changes.patch(base, change, "id").collect())) == [(1, "a", None), (2, "z", "y")]


def test_missing_map_key_differs_from_null(spark):
    df = frame(spark, [(1, {"a": None}), (2, {})], "id int, m map<string,string>")
    assert values(filters.where_exists(df, "m", "a"), "id") == [(1,)]
    assert values(filters.where_exists(df, "m", "a", exists=False), "id") == [(2,)]


def test_redrive_threshold(spark):
    rows = [("a", False)] * 5 + [("b", False)] * 4 + [("c", False)] * 6 + [("c", True)]
    dead, retry = log.redrive(frame(spark, rows, "m string, ok boolean"), "m", ~F.col("ok"))
    assert values(dead, "m") == [("a",)] and values(retry, "m") == [("b",)]


def test_policy_without_attribute_map_entry(spark):
    df = frame(spark, [(1, {"Priority": "High"}), (2, {})], "id int, attrs map<string,string>")
    assert values(filters.match_policy(df, {"Priority": [{"exists": True}]}, attributes="attrs"), "id") == [(1,)]
    assert values(filters.match_policy(df, {"Priority": [{"anything-but": "Low"}]}, attributes="attrs"), "id") == [(1,)]
