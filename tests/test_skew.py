"""Hot keys: one key holds most rows, and the results still equal a plain per-key loop."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.functions import ordered
from opsloom.functions.timeutil import from_micros
from opsloom.operators import limits, metrics, traces
from opsloom.operators.graph import reach
from opsloom.operators.joins import asof_join, cidr_enrich
from opsloom.operators.ranking import keep_last, latest_by
from opsloom.operators.search import knn
from opsloom.streaming.windows import sessions


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made, now = [], 0
    for i in range(1500):
        now += rng.choice([0, 1, 3, 20, 300])
        made.append(("hot" if rng.random() < 0.7 else f"k{rng.randrange(6)}", now, i, rng.randrange(-5, 9)))
    return made


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, us long, id long, v long").repartition(5).cache()


def by_key(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[row[0]].append(row)
    return groups


@pytest.mark.parametrize("width", [7, 500, 10**9])
def test_running_sum_and_previous_any_chunk(df, rows, width):
    chunk = ordered.slots("us", width)
    got = {r["id"]: (r["s"], r["p"]) for r in ordered.previous(
        ordered.running_sum(df, ["k"], ["us", "id"], chunk, {"s": F.col("v")}), ["k"], ["us", "id"], chunk, {"p": F.col("id")}).collect()}
    for group in by_key(rows).values():
        total, before = 0, None
        for _, _, i, v in group:
            total += v
            assert got[i] == (total, before)
            before = i


@pytest.mark.parametrize("fan", [1, 5, 1000])
def test_carry_in_two_levels(spark, df, rows, fan):
    """Many more chunks of the hot key than one task orders; null keys, null orders and null values have their places."""
    odd = spark.createDataFrame([("hot", None, -1, 4), (None, None, -2, 1), (None, 5, -3, None), (None, 90, -4, 2)], df.schema)
    both = df.unionByName(odd)
    chunk = ordered.slots("us", 3)
    sums = ordered.running_sum(both, ["k"], ["us", "id"], chunk, {"s": F.col("v")}, fan)
    lags = ordered.previous(sums, ["k"], ["us", "id"], chunk, {"p": F.col("id")}, fan)
    seen = ordered.last_seen(lags, ["k"], ["us", "id"], chunk, F.col("v") > 6, {"seen": F.col("id")}, fan)
    got = {r["id"]: (r["s"], r["p"], r["seen"]) for r in seen.collect()}
    groups = by_key([r for r in rows])
    groups["hot"].insert(0, ("hot", None, -1, 4))
    groups[None] = [(None, None, -2, 1), (None, 5, -3, None), (None, 90, -4, 2)]
    assert len(got) == sum(map(len, groups.values()))
    for group in groups.values():
        total, before, last = 0, None, None
        for _, _, i, v in group:
            total += v or 0
            last = i if v is not None and v > 6 else last
            assert got[i] == (total, before, last)
            before = i


def test_carry_orders_runs_of_chunks(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("us"))
    summed = ordered.running_sum(df, ["k"], ["us"], ordered.slots("us", 2), {"s": F.lit(1)}, 10)
    assert [r["s"] for r in summed.orderBy("us").collect()] == list(range(1, 1001))
    plan = summed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3 and "windowspecdefinition(_run#" in plan


@pytest.mark.parametrize("width", [7, 500, 10**9])
def test_last_seen_any_chunk(df, rows, width):
    got = {r["id"]: r["seen"] for r in ordered.last_seen(
        df, ["k"], ["us", "id"], ordered.slots("us", width), F.col("v") > 6, {"seen": F.col("id")}).collect()}
    for group in by_key(rows).values():
        seen = None
        for _, _, i, v in group:
            seen = i if v > 6 else seen
            assert got[i] == seen


def test_positions(df, rows):
    got = {r["id"]: (r["pos"], r["size"]) for r in ordered.position(df, ["k"], ["us", "id"], ordered.slots("us", 100), "pos", "size").collect()}
    for group in by_key(rows).values():
        for pos, row in enumerate(group):
            assert got[row[2]] == (pos, len(group))


def test_global_position(df, rows):
    got = {r["id"]: r["pos"] for r in ordered.global_position(df, [F.desc("v"), F.asc("id")]).collect()}
    for pos, row in enumerate(sorted(rows, key=lambda r: (-r[3], r[2]))):
        assert got[row[2]] == pos


def test_first_n_and_latest(df, rows):
    got = {r["id"] for r in keep_last(df, "k", ["us", "id"], "id", 4).collect()}
    assert got == {r[2] for g in by_key(rows).values() for r in g[-4:]}
    newest = {r["k"]: r["id"] for r in latest_by(df, ["k"], ["us", "id"]).collect()}
    assert newest == {k: g[-1][2] for k, g in by_key(rows).items()}


@pytest.mark.parametrize("chunk", [50, 4000])
def test_trailing_count(df, rows, chunk):
    got = {r["id"]: r["n"] for r in ordered.trailing_count(df, ["k"], "us", 50, chunk).collect()}
    for group in by_key(rows).values():
        for _, us, i, _ in group:
            assert got[i] == sum(us - 50 <= r[1] <= us for r in group)


def test_fixed_window_salts(df, rows):
    timed = df.withColumn("ts", from_micros("us"))
    got = {r["id"]: r["allowed"] for r in limits.rate_fixed(timed, "k", "ts", "id", 3, 0.0005, salts=4).collect()}
    assert len(got) == len(rows)
    used = defaultdict(int)
    for k, us, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        used[(k, us // 500)] += 1
        assert got[i] == (used[(k, us // 500)] <= 3)


FOLDS = {
    "anchored": (limits.anchored_fold(3, 100), {"reset_us": 100, "harmless": limits._within(3, 100)}),
    "sliding": (limits.sliding_fold(3, 100), {"reset_us": 100, "harmless": limits._within(3, 100)}),
    "token": (limits.token_fold(3, 40), {"cost_us": 40, "harmless": limits._below(120, 40)}),
    "leaky": (limits.leaky_fold(2, 40), {"cost_us": 40, "harmless": limits._below(120, 40)}),
}


@pytest.mark.parametrize("name", sorted(FOLDS))
@pytest.mark.parametrize("chunk_us", [10**9, 1000, 70])
def test_folds_equal_one_pass_per_key(df, rows, name, chunk_us):
    fold, options = FOLDS[name]
    got = {r["id"]: r["allowed"] for r in limits.fold_by_key(df, "k", "us", "id", fold, chunk_us=chunk_us, **options).collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        flags, _ = fold(np.array([r[1] for r in group]), np.empty((len(group), 0)), None)
        assert [got[r[2]] for r in group] == flags.tolist()


def test_busy_periods_split_a_key_that_never_pauses(spark):
    """A hot key below its rate has many periods, and none of them is decided request by request."""
    df = spark.createDataFrame([("hot", 45 * i + (i % 3), i) for i in range(600)], "k string, us long, id long")
    segments = limits._busy_periods(df, "k", "us", "id", 40, 500).groupBy("_seg").count().collect()
    assert len(segments) > 300

    def deny(times, amounts, state):
        return np.zeros(len(times), dtype=bool), [0]
    found = limits.fold_by_key(df, "k", "us", "id", deny, cost_us=40, harmless=limits._below(120, 40))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2  # the input, also behind the chunks' summaries
    # Only the last period of a batch, which may go on, is decided request by request.
    assert sum(r["allowed"] for r in found.collect()) >= 600 - 4 * 4


def test_sized_requests_in_slices(spark, rows):
    stock = spark.createDataFrame([("hot", 900), *[(f"k{i}", 40) for i in range(6)]], "k string, stock long")
    asks = spark.createDataFrame([(k, us, i, abs(v)) for k, us, i, v in rows], "k string, us long, id long, want long").withColumn("ts", from_micros("us"))
    got = {r["id"]: r["allowed"] for r in limits.decrement_by(stock, asks, "k", "stock", "want", "ts", "id").collect()}
    left = {"hot": 900, **{f"k{i}": 40 for i in range(6)}}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        ok = abs(v) <= left[k]
        left[k] -= abs(v) if ok else 0
        assert got[i] == ok


def test_sessions_of_a_hot_key(df, rows):
    timed = df.select("k", "id", from_micros(F.col("us") * 1_000_000).alias("ts"))
    got = sorted((r["k"], r["n"]) for r in sessions(timed, "k", "ts", "id", 60, chunk_seconds=500).collect())
    want = []
    for k, group in by_key(rows).items():
        size = 1
        for a, b in zip(group, group[1:]):
            if b[1] - a[1] >= 60:
                want.append((k, size))
                size = 0
            size += 1
        want.append((k, size))
    assert got == sorted(want)


def test_exact_percentiles_of_a_hot_group(df, rows):
    got = {(r["k"], r["q"]): r["us"] for r in metrics.exact_percentiles(df, ["k"], "us", [0.01, 0.5, 0.95, 1.0], 64).collect()}
    for k, group in by_key(rows).items():
        ordered_values = sorted(r[1] for r in group)
        for q in (0.01, 0.5, 0.95, 1.0):
            rank = max(1, int(np.ceil(q * len(ordered_values))))
            assert got[(k, q)] == ordered_values[rank - 1]


def test_burst_anomaly(spark):
    hours = [(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", 75 if h == 60 else 1 + h % 2) for h in range(72)]
    calls = spark.createDataFrame([(t, "CreateUser") for t, n in hours for _ in range(n)], "t string, api string")
    found = traces.api_anomalies(calls.withColumn("ts", F.col("t").cast("timestamp_ntz")), "api", "ts", 3600, 24, 3.0).collect()
    assert [(r["peak"], r["periods"]) for r in found] == [(75, 1)]


# --- missing keys and times -------------------------------------------------------------------

GAPS = [(None, 5, 1, 2), (None, 9, 2, 3), ("a", None, 3, 4), ("a", 7, 4, 5), ("a", None, 5, 1), (None, None, 6, 9), ("a", 12, 7, 1)]


@pytest.fixture(scope="module")
def holes(spark):
    return spark.createDataFrame(GAPS, "k string, us long, id long, v long").repartition(3)


def test_rows_with_null_keys_and_times_stay(holes):
    chunk = ordered.slots("us", 5)
    got = {r["id"]: (r["s"], r["p"], r["pos"], r["size"]) for r in ordered.position(ordered.previous(
        ordered.running_sum(holes, ["k"], ["us", "id"], chunk, {"s": F.col("v")}), ["k"], ["us", "id"], chunk, {"p": F.col("id")}),
        ["k"], ["us", "id"], chunk, "pos", "size").collect()}
    assert got == {6: (9, None, 0, 3), 1: (11, 6, 1, 3), 2: (14, 1, 2, 3),
                   3: (4, None, 0, 4), 5: (5, 3, 1, 4), 4: (10, 5, 2, 4), 7: (11, 4, 3, 4)}


def test_asof_keeps_left_rows_without_key_or_time(spark, holes):
    timed = lambda df: df.withColumn("ts", from_micros("us")).drop("us")
    right = timed(spark.createDataFrame([(None, 6, 100), ("a", 6, 200), ("a", None, 300)], "k string, us long, rid long"))
    got = {r["id"]: r["rid"] for r in asof_join(timed(holes), right, ["k"], "ts", "rid", ["rid"]).collect()}
    assert got == {1: None, 2: 100, 3: None, 4: 200, 5: None, 6: None, 7: 200}


def test_null_keys_share_one_limiter(spark):
    df = spark.createDataFrame([(None, i, i) for i in range(3)], "k string, s long, id long").withColumn("ts", from_micros(F.col("s") * 1_000_000))
    got = {r["id"]: r["allowed"] for r in limits.rate_anchored(df, "k", "ts", "id", 1, 60).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_silent_periods_have_a_state(spark):
    hours = spark.createDataFrame([("a", h, 1.0) for h in (0, 1, 2, 9)] + [(None, 4, 9.0)], "k string, h long, v double").withColumn(
        "period", from_micros(F.col("h") * 3_600_000_000)).drop("h")
    got = metrics.alarm(hours, ["k"], "period", "v", 3600, 5.0, 3, 1).collect()
    assert len(got) == 11
    states = {r["period"].hour: r["state"] for r in got if r["k"] == "a"}
    assert states[2] == "OK" and {states[h] for h in range(3, 10)} == {"INSUFFICIENT_DATA"}
    assert [r["state"] for r in got if r["k"] is None] == ["ALARM"]


def test_foreign_prefixes_hide_no_match(spark):
    nets = [("10.0.1.0/24", "small"), ("10.0.0.0/8", "large"), ("bad/9", "x"), ("10.0.0.0/40", "y")] + [(f"2001:db8::/{n}", "six") for n in range(33, 129)]
    inventory = spark.createDataFrame(nets, "cidr string, owner string")
    flows = spark.createDataFrame([("10.0.1.7",), ("10.9.9.9",), ("11.0.0.1",), (None,), ("::1",)], "addr string")
    got = {r["addr"]: r["owner"] for r in cidr_enrich(flows, "addr", inventory, ["owner"]).collect()}
    assert got == {"10.0.1.7": "small", "10.9.9.9": "large", "11.0.0.1": None, None: None, "::1": None}


def test_unknown_products_are_refused(spark):
    stock = spark.createDataFrame([("a", 5)], "p string, n long")
    asked = spark.createDataFrame([("a", 1, 3, 1), ("b", 1, 3, 2)], "p string, s long, want long, id long").withColumn("ts", from_micros("s"))
    got = {r["id"]: r["allowed"] for r in limits.decrement_by(stock, asked, "p", "n", "want", "ts", "id").collect()}
    assert got == {1: True, 2: False}


def test_baseline_counts_silent_periods(spark):
    counts = spark.createDataFrame([("a", 0, 6), ("a", 1, 6), ("a", 10, 4)], "k string, h long, n long").withColumn(
        "period", from_micros(F.col("h") * 3_600_000_000))
    got = {r["h"]: r["baseline"] for r in metrics.trailing_baseline(counts, ["k"], "period", "n", 24, 3600).collect()}
    assert got == {0: None, 1: 6.0, 10: 1.2}


def test_reach_goes_on_to_the_end(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n9", "n0")], "parent string, child string")
    got = reach(edges, spark.createDataFrame([("n0",)], "node string")).collect()
    assert sorted((r["hops"], r["node"]) for r in got) == [(i, f"n{i}") for i in range(10)]


def test_bounded_percentiles_keep_their_rank_error(spark):
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("v"))
    got = metrics.latency_percentiles(df, ["k"], "v", [0.5, 0.95], 1_000).first()
    values = np.sort([r["v"] for r in df.collect()])
    for q, name in ((0.5, "p50"), (0.95, "p95")):
        assert abs(np.searchsorted(values, got[name]) / len(values) - q) <= 1 / 1_000


def test_merged_registers_are_those_of_all_rows(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.lit("m").alias("month"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("u"))
    merged = metrics.estimate_uniques(metrics.merge_registers(metrics.unique_registers(df, ["day", "month"], "u"), "month"), "month")
    whole = metrics.unique_visitors(df, "u", "month")
    assert merged.collect() == whole.collect()
    exact = df.agg(F.count_distinct("u")).first()[0]
    assert abs(whole.first()["uniques"] / exact - 1) < 0.03


def test_nearest_by_blocks_equals_one_block(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 5)))] + [(500, [0.0] * 5), (501, None)]
    df = spark.createDataFrame(vectors, "id long, v array<double>")
    asked = df.select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    small = knn(df, "id", "v", asked, 4, query_block=7, vector_block=11).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, knn(df, "id", "v", asked, 4).collect()))
    assert len(small) == 480 and all(r["id"] == r["query_id"] for r in small if r["rank"] == 1)
