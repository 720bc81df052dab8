"""Stored structures: Bloom filters, posting lists and quantile sketches against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from opsloom.operators import membership, metrics
from opsloom.operators.postings import Postings
from opsloom.session import work_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_keeps_members_and_the_stated_rate(spark):
    members = spark.range(20_000).withColumnRenamed("id", "k")
    for rate in (0.1, 0.01):
        stored = membership.build(members, "k", membership.blocks_for(20_000, rate))
        found = membership.quality(spark.range(60_000).withColumnRenamed("id", "k"), members, "k", stored, rate).first()
        assert found.asDict() == {"strangers": 40_000, "false_negatives": 0, "within_rate": True}


def test_rate_is_monotone_and_full_filters_pass_all():
    rates = [membership.false_positive_rate(10_000, 2 ** b) for b in range(12)]
    assert rates == sorted(rates, reverse=True) and rates[0] == 1.0 and rates[-1] < 1e-6
    assert membership.blocks_for(0, 0.01) == 1
    with pytest.raises(ValueError):
        membership.blocks_for(10, 0.0)


def test_merged_filters_know_the_keys_of_all(spark):
    low, high = spark.range(0, 500).withColumnRenamed("id", "k"), spark.range(500, 1000).withColumnRenamed("id", "k")
    whole = membership.build(low.union(high), "k", 16)
    merged = membership.merge(membership.build(low, "k", 16), membership.build(high, "k", 64))
    as_rows = lambda f: sorted(tuple(r[c] for c in ["block", "blocks", *membership.NAMES]) for r in f.collect())
    assert as_rows(merged) == as_rows(whole)
    once = membership.merge(merged, merged)
    assert as_rows(once) == as_rows(whole)


def test_filter_edge_cases(spark):
    schema = "k string, block int, _v int"
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 3), ("", 4, 4), ("é", 5, 5)], schema)
    members = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "k string")
    kept = membership.member_rows(rows, members, "k", membership.build(members, "k", 64))
    assert kept.columns == ["k", "block", "_v"]
    assert sorted(r["_v"] for r in kept.collect()) == [1, 2, 4]
    empty = membership.build(members.where("false"), "k", 64)
    assert membership.might_contain(rows, "k", empty).count() == 0
    assert membership.merge(empty, empty).count() == 0


def test_index_answers_as_a_scan_does(spark):
    random.seed(3)
    words = ["the", "a", "Rare", "été", "x1", "co-op"]
    texts = [(i, " ".join(random.choices(words, [9, 5, 1, 3, 2, 1], k=random.randint(0, 9)))) for i in range(300)]
    docs = spark.createDataFrame([*texts, texts[5], (900, None), (901, ""), (None, "the rare")], "doc_id long, text string")
    written = Postings.write(docs, "doc_id", "text", work_path(spark, "index"), term_buckets=8, doc_buckets=3)
    index = Postings.open(spark, written.path)
    held = {i: set(t.lower().replace("-", " ").split()) for i, t in texts}
    for terms in (["the"], ["THE", "rare"], ["x1", "été", "a"], ["co", "op"], ["co-op"], ["absent", "the"]):
        want = sorted(i for i, have in held.items() if {t.lower() for t in terms} <= have)
        assert sorted(r[0] for r in index.search(terms).collect()) == want, terms
    counts = {r["term"]: r["docs"] for r in index.frequencies().collect()}
    assert counts == {w: sum(w in have for have in held.values()) for w in set().union(*held.values())}
    with pytest.raises(ValueError):
        index.search([])


def test_search_reads_its_buckets_without_a_shuffle(spark):
    docs = spark.range(200).select("id", F.concat(F.lit("w"), F.col("id") % 5, F.lit(" all v"), F.col("id") % 3).alias("text"))
    index = Postings.write(docs, "id", "text", work_path(spark, "index"), term_buckets=16, doc_buckets=4)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.search(["all", "w1", "v2"])
        text = plan(found)
        assert found.count() == sum(i % 5 == 1 and i % 3 == 2 for i in range(200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert text.count("PartitionFilters: [isnotnull(bucket") == 3


def test_an_index_survives_its_session_catalog(spark):
    docs = spark.createDataFrame([("p", "red fox"), ("q", "red hen")], "name string, text string")
    written = Postings.write(docs, "name", "text", work_path(spark, "index"))
    spark.sql(f"DROP TABLE {written.table}")
    assert [r[0] for r in Postings.open(spark, written.path).search(["fox", "red"]).collect()] == ["p"]
    nothing = Postings.write(docs.where("false"), "name", "text", work_path(spark, "index"))
    assert nothing.search(["red"]).count() == 0


def test_merged_sketches_err_within_their_bound(spark):
    df = spark.range(200_000).select((F.col("id") % 37).alias("day"), (F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("g"))).alias("g"),
                                     F.pow(F.rand(4), F.lit(3)).alias("v"))
    merged = metrics.merge_sketches(metrics.quantile_sketches(df, ["g", "day"], "v"), "g")
    found = metrics.rank_errors(df, ["g"], "v", metrics.sketch_quantiles(merged, ["g"], [0.01, 0.5, 0.99])).collect()
    assert {(r["g"], r["q"]) for r in found} == {(g, q) for g in (None, "g") for q in (0.01, 0.5, 0.99)}
    assert max(r["error"] for r in found) < 0.01 and {r["n"] for r in found} == {66_667, 133_333}


def test_sketches_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", 2.0)], "g string, v double")
    sketches = metrics.quantile_sketches(df, ["g"], "v")
    found = metrics.sketch_quantiles(sketches, ["g"], [0.5])
    assert [tuple(r) for r in found.collect()] == [("b", 2, 0.5, 2.0)]
    assert [r["error"] for r in metrics.rank_errors(df, ["g"], "v", found).collect()] == [0.0]


def test_rows_of_an_index_task_do_not_grow_with_the_table(spark, monkeypatch):
    """More text makes more tasks, before the rows are made distinct and when they are written; a term in every text is no exception."""
    from opsloom.operators import postings

    monkeypatch.setattr(postings, "TASK_BYTES", 2_000)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        most = []
        for n in (500, 4_000):
            docs = spark.range(n, numPartitions=8).selectExpr("id AS doc_id", "concat('the w', id % 97) AS text")
            index = Postings.write(docs, "doc_id", "text", work_path(spark, "index"), term_buckets=2, doc_buckets=2)
            rows = index.postings()
            most.append(rows.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
            assert rows.count() == 2 * n == rows.distinct().count() and index.search(["the", "w5"]).count() == len(range(5, n, 97))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert most[1] < 4 * most[0]
