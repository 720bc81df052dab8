"""Registered queries: search, traces, audit and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import search, traces as op
from opsloom.operators.postings import Postings
from opsloom.plans.registry import query
from opsloom.plans.roles import EV, SEGMENTS, WEB, ev, segments, sql, web
from opsloom.session import work_path

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("S1", f"SELECT doc_id FROM documents WHERE list_contains({WORDS}, 'the') AND list_contains({WORDS}, 'that')")
def text_search(t):
    return search.text_search(t.documents, "text", ["the", "That"]).select("doc_id")


@query("S1", f"SELECT doc_id FROM documents WHERE list_contains({WORDS}, 'the') AND list_contains({WORDS}, 'that')")
def text_search_by_index(t):
    index = search.inverted_index(t.documents, "doc_id", "text")
    return search.index_search(index, "doc_id", ["the", "that"])


@query("S1", f"SELECT term, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct({WORDS})) AS term FROM documents) GROUP BY 1")
def index_term_counts(t):
    return search.inverted_index(t.documents, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


def _stored(t):
    return Postings.write(t.documents, "doc_id", "text", work_path(t.spark, "index"))


@query("S1", f"SELECT doc_id FROM documents WHERE list_contains({WORDS}, 'the') AND list_contains({WORDS}, 'that')")
def text_search_stored(t):
    # The index is written once; the search opens it again by its path.
    return Postings.open(t.spark, _stored(t).path).search(["the", "That"])


@query("S1", f"SELECT term, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct({WORDS})) AS term FROM documents) GROUP BY 1")
def stored_term_counts(t):
    return _stored(t).frequencies().select("term", "docs")


@query("S3", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['ring', 'bolt'])")
def tag_search_any(t):
    tagged = t.part.withColumn("tags", F.split("p_name", " "))
    return search.tag_search(tagged, "tags", ["ring", "bolt"]).select("p_partkey")


@query("S3", "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'widget'])")
def tag_search_all(t):
    tagged = t.part.withColumn("tags", F.split("p_name", " "))
    return search.tag_search(tagged, "tags", ["red", "widget"], any_of=False).select("p_partkey")


@query("S4", f"""SELECT term, count(*) AS n FROM (SELECT unnest({WORDS}) AS term FROM documents) WHERE starts_with(term, 'th') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def prefix_suggestions(t):
    words = t.documents.select(F.explode(search.tokens("text")).alias("term"))
    return search.suggest(words, "term", "th", 10)


@query("S5", """WITH g AS (SELECT c_custkey, CAST((c_custkey * 37) % 400 AS DOUBLE) / 100 + 10 AS lon, CAST((c_custkey * 91) % 300 AS DOUBLE) / 100 + 50 AS lat FROM customer),
d AS (SELECT c_custkey, 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(lat - 51.5::DOUBLE) / 2), 2)
 + cos(radians(51.5::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - 12::DOUBLE) / 2), 2))) AS km FROM g)
SELECT c_custkey, round(km, 3) AS km FROM d WHERE km <= 40""")
def radius_search(t):
    places = t.customer.select("c_custkey", ((F.col("c_custkey") * 37 % 400).cast("double") / 100 + 10).alias("lon"),
                               ((F.col("c_custkey") * 91 % 300).cast("double") / 100 + 50).alias("lat"))
    return search.geo_radius(places, "lon", "lat", (12.0, 51.5), 40).select("c_custkey", F.round("km", 3).alias("km"))


@query("S6", """WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY 1),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS cosine FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, vec_id, round(cosine, 6) AS cosine FROM r WHERE rank <= 10""")
def nearest_vectors(t):
    # One query vector per label: the first of each.
    firsts = t.embeddings.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    found = search.knn(t.embeddings, "vec_id", "embedding", firsts, 10)
    return found.select("query_id", "rank", "vec_id", F.round("cosine", 6).alias("cosine"))


# --- traces -----------------------------------------------------------------------------------

@query("T1", sql(SEGMENTS) + """SELECT trace_id, count(*) AS segments, max(end_ms) - min(start_ms) AS latency_ms, bool_or(status >= 400) AS has_error
FROM segments GROUP BY 1""")
def assembled_traces(t):
    return op.traces(segments(t))


@query("T2", sql(SEGMENTS) + "SELECT trace_id, service, CAST(sum(end_ms - start_ms) AS BIGINT) AS busy_ms FROM segments GROUP BY 1, 2")
def trace_timeline(t):
    return op.timeline(segments(t))


@query("T2", sql(SEGMENTS) + """, b AS (SELECT trace_id, service, CAST(sum(end_ms - start_ms) AS BIGINT) AS busy_ms FROM segments GROUP BY 1, 2)
SELECT trace_id, service, busy_ms FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY busy_ms DESC, service DESC) AS rn FROM b) WHERE rn = 1""")
def trace_bottleneck(t):
    return op.bottleneck(segments(t))


@query("T3", sql(SEGMENTS) + """SELECT trace_id, max(end_ms) - min(start_ms) AS latency_ms FROM segments GROUP BY 1
HAVING max(end_ms) - min(start_ms) >= 3000 AND bool_or(service = '7' AND status >= 500 AND annotation = 'O')""")
def found_traces(t):
    wanted = (F.col("service") == "7") & (F.col("status") >= 500) & (F.col("annotation") == "O")
    return op.find_traces(segments(t), wanted, 3000).select("trace_id", "latency_ms")


@query("T4", sql(SEGMENTS) + """SELECT a.service AS caller, b.service AS callee, count(*) AS calls, CAST(sum(b.end_ms - b.start_ms) AS BIGINT) / count(*) AS mean_ms,
count(*) FILTER (b.status BETWEEN 400 AND 499 AND b.status <> 429) / count(*) AS error_rate, count(*) FILTER (b.status >= 500) / count(*) AS fault_rate,
count(*) FILTER (b.status = 429) / count(*) AS throttle_rate FROM segments a JOIN segments b ON a.trace_id = b.trace_id AND b.parent_id = a.segment_id GROUP BY 1, 2""")
def service_map(t):
    return op.service_map(segments(t))


@query("T5", sql(SEGMENTS) + """SELECT make_timestamp(epoch_us(ts) // 2592000000000 * 2592000000000) AS slot, service, count(*) AS calls,
count(*) FILTER (status BETWEEN 400 AND 499 AND status <> 429) AS error, count(*) FILTER (status >= 500) AS fault, count(*) FILTER (status = 429) AS throttle
FROM segments GROUP BY 1, 2""")
def service_statistics(t):
    return op.service_stats(segments(t), 30 * 86400)


@query("T6", sql(SEGMENTS) + """SELECT service, count(*) AS calls, count(*) FILTER (status BETWEEN 400 AND 499 AND status <> 429) AS error,
count(*) FILTER (status >= 500) AS fault, count(*) FILTER (status = 429) AS throttle FROM segments GROUP BY 1""")
def classified_errors(t):
    return op.classify_errors(segments(t), ["service"])


@query("T8", sql(WEB) + """SELECT event_type || 'User' AS "eventName", 'r' || CAST(status AS VARCHAR) AS "awsRegion", client AS "userName", count(*) AS n
FROM web GROUP BY 1, 2, 3""")
def audit_records(t):
    record = F.struct(F.lit("1.08").alias("eventVersion"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
                      F.lit("iam").alias("eventSource"), F.concat(F.col("event_type"), F.lit("User")).alias("eventName"),
                      F.concat(F.lit("r"), F.col("status").cast("string")).alias("awsRegion"),
                      F.struct(F.lit("User").alias("type"), F.col("client").alias("userName")).alias("userIdentity"))
    files = web(t).select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("body"))
    flat = op.audit_events(files, "body")
    return flat.groupBy("eventName", "awsRegion", F.col("userIdentity.userName").alias("userName")).agg(F.count(F.lit(1)).alias("n"))


ANOMALY = """c AS (SELECT date_trunc('hour', ts) AS period, event_type, count(*) AS n FROM ev {where} GROUP BY 1, 2),
k AS (SELECT *, epoch_us(period) // 3600000000 AS k FROM c),
s AS (SELECT *, least(24, k - min(k) OVER (PARTITION BY event_type)) AS m, coalesce(sum(n) OVER w, 0) AS s1, coalesce(sum(n * n) OVER w, 0) AS s2
  FROM k WINDOW w AS (PARTITION BY event_type ORDER BY k RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, CAST(s1 AS DOUBLE) / nullif(m, 0) AS baseline, sqrt(CAST(m * s2 - s1 * s1 AS DOUBLE) / nullif(m * (m - 1), 0)) AS deviation FROM s),
h AS (SELECT *, CASE WHEN period - lag(period) OVER (PARTITION BY event_type ORDER BY period) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens
  FROM b WHERE n > baseline + deviation * 1.5::DOUBLE),
g AS (SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY period) AS run FROM h)
SELECT event_type, min(period) AS start, max(period) + INTERVAL 1 HOUR AS "end", arg_min(baseline, period) AS baseline, max(n) AS peak, count(*) AS periods
FROM g GROUP BY event_type, run"""


@query("T9", sql(EV, ANOMALY.format(where="")).rstrip())
def call_rate_anomalies(t):
    return op.api_anomalies(ev(t), "event_type", "ts", 3600, 24, 1.5)


@query("T9", sql(EV, ANOMALY.format(where="WHERE k >= 50")).rstrip())
def error_rate_anomalies(t):
    return op.api_anomalies(ev(t), "event_type", "ts", 3600, 24, 1.5, F.col("k") >= 50)


@query("T12", """WITH f AS (SELECT doc_id, sha256(text) AS d FROM documents WHERE lang <> 'es'),
g AS (SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 5 THEN text || '!' ELSE text END) AS d FROM documents WHERE lang <> 'de')
SELECT coalesce(f.doc_id, g.doc_id) AS doc_id, CASE WHEN f.d IS NULL THEN 'missing file' WHEN g.d IS NULL THEN 'no digest' WHEN f.d = g.d THEN 'match' ELSE 'mismatch' END AS state
FROM f FULL JOIN g ON f.doc_id = g.doc_id""")
def verified_digests(t):
    found = t.documents.where("lang <> 'es'").select("doc_id", F.sha2("text", 256).alias("digest"))
    listed = t.documents.where("lang <> 'de'").select(
        "doc_id", F.sha2(F.when(F.col("doc_id") % 13 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return op.verify_digests(found, listed, "doc_id")
