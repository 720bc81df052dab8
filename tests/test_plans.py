"""Physical plans: pruning, pushdown and the absence of one-task and cross-join steps."""

import pytest
from pyspark.sql import functions as F

from opsloom.operators import aggregates, filters
from opsloom.plans.catalogue import REGISTRY
from opsloom.plans.registry import Tables
from opsloom.plans.roles import flow
from opsloom.plans.sources import bucketed_pair
from opsloom.sources import scan, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(aggregates.top_talkers(flow(Tables(spark, data)), "2001-11-05", 700))
    assert "l_tax" not in text and "l_discount" not in text
    day = plan(filters.where_day(spark.read.parquet(f"{data}/events.parquet"), "ts", "2024-01-05").select("event_id"))
    assert "GreaterThanOrEqual(ts" in day and "LessThan(ts" in day
    assert "props" not in day


def test_partition_filter(spark, data, tmp_path):
    orders = spark.read.parquet(f"{data}/orders.parquet").withColumn("year", F.year("o_orderdate"))
    sinks.write_columnar(orders, str(tmp_path / "o"), by=["year"])
    text = plan(scan.scan_partitioned(spark, str(tmp_path / "o"), F.col("year") == 1997))
    assert "PartitionFilters: [isnotnull(year" in text


def test_top_n_per_key_is_cut_before_the_shuffle(spark, data):
    assert plan(REGISTRY["keep_last_per_user"](spark, data)).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["cidr_enrichment", "traffic_scope", "nearest_vectors", "service_map", "last_click_before_purchase",
                                  "graph_reach", "revenue_by_region", "topology_drift", "contributor_report"])
def test_no_cross_join(spark, data, name):
    text = plan(REGISTRY[name](spark, data))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["replay_running", "user_sessions", "rate_sliding_count", "retain_by_bytes", "list_range", "logging_gaps"])
def test_detail_windows_are_chunked(spark, data, name):
    """Windows that sort detail rows partition by key and chunk, never by the key alone."""
    text = plan(REGISTRY[name](spark, data))
    assert "_chunk" in text and "SinglePartition" not in text


def test_bucketed_tables_join_without_a_shuffle(spark, data):
    orders, lines = bucketed_pair(Tables(spark, data))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_shared_aggregates_are_computed_once(spark, data):
    df = REGISTRY["hot_keys"](spark, data)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_no_broadcast_hints():
    import pathlib
    source = "".join(p.read_text() for p in pathlib.Path("opsloom").rglob("*.py"))
    assert "F.broadcast(" not in source and "localCheckpoint" not in source and "crossJoin" not in source


def test_deep_pages_open_one_part(spark):
    """A position deep in the order reads the parts that hold it, without a top-k over all rows before it."""
    from opsloom.operators.ranking import Ordered
    from opsloom.session import work_path
    df = spark.range(5_000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    stored = Ordered.write(df, work_path(spark, "ordered"), [("a", True), ("b", False)], parts=16)
    want = sorted(((i % 7, i) for i in range(5_000)), key=lambda r: (-r[0], r[1]))
    for start, stop in [(0, 4), (3_111, 3_130), (4_990, 6_000), (-3, -1), (-9_000, 1), (7, 2), (-2, -9_000)]:
        low, high = (max(0, i + 5_000) if i < 0 else i for i in (start, stop))
        rows = sorted((r["pos"], r["a"], r["b"]) for r in stored.slice(start, stop).collect())
        assert rows == [(i, *want[i]) for i in range(low, min(high + 1, 5_000)) if stop >= -5_000]
    page = stored.page(200, 20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "PartitionFilters" in plan and "PartitionFilters: []" not in plan
    assert {r["total"] for r in page.collect()} == {5_000} and page.count() == 20
    assert stored.directory().count() > 8
    empty = Ordered.write(df.where("b < 0"), work_path(spark, "ordered"), [("a", True), ("b", False)])
    assert empty.size() == 0 and empty.slice(0, 9).count() == 0
