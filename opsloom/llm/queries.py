"""Registered queries of this package, and their SQL where SQL can express them.

Each query applies one operator with its production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import ann, bpe, dialogue, licenses, merkle, mixing, nbsvm, neardup, quality, secret_scan, substring, token_file, toxicity
from opsloom.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build
    return register


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "documents")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file, the same on all machines."""
    import public_tokenizers
    return public_tokenizers.path(name)


# --- op1 ---------------------------------------------------------------------------------------

@_query()
def op1_nearest_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, among all."""
    vectors = _table(spark, path, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


# --- op2 ---------------------------------------------------------------------------------------

@_query()
def op2_toxicity(spark: SparkSession, path: str) -> DataFrame:
    """Probabilities of the chain (low quality, then toxic) for every document."""
    docs = _documents(spark, path)
    chain = toxicity.train(docs, _table(spark, path, "labels"), {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return toxicity.score(docs, chain)


# --- op3 ---------------------------------------------------------------------------------------

@_query()
def op3_source_mix(spark: SparkSession, path: str) -> DataFrame:
    """Words that the mix takes of every document."""
    plan = mixing.mix_plan(_documents(spark, path))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["taken"])
    return plan.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


# --- op4 ---------------------------------------------------------------------------------------

@_query()
def op4_secret_scan(spark: SparkSession, path: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = _documents(spark, path)
    return secret_scan.scan_secrets(docs, words=secret_scan.frequent_words(docs), with_text=False).drop("masked")


# --- op5 ---------------------------------------------------------------------------------------

_SPACE = r"[\x20\x09-\x0D]"
_STOP_SQL = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_SYMBOLS_SQL = "[#*$%&|<>]"


def _rule_sql(rule: quality.Rule) -> str:
    value = f"CAST({rule.top} AS DOUBLE)"
    if rule.bottom:
        value = f"(CASE WHEN {rule.bottom} > 0 THEN {value} / {rule.bottom} ELSE 0 END)"
    limits = [f"{value} {op} {limit}" for op, limit in ((">=", rule.low), ("<=", rule.high)) if limit is not None]
    return " AND ".join(limits)


@_query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '{_SYMBOLS_SQL}', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop_words, len(ls) AS n_lines,
             length(t) - length(replace(t, '!', '')) AS n_exclamations,
             len(list_filter(ls, lambda x: ltrim(x)[1] IN ('-', '*', '•'))) AS n_bullet_lines,
             len(list_filter(ls, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ellipsis_lines
      FROM w LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(_rule_sql(r) for r in quality.RULES)} AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)""")
def op5_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    """Counts and verdict for every document."""
    return quality.apply_rules(_documents(spark, path)).select("doc_id", *[F.col(f"quality.{c}") for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


# --- op6 ---------------------------------------------------------------------------------------

@_query()
def op6_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Every document as read back from a token file of the whole table."""
    file = work_path(spark, "tokens")
    token_file.write_tokens(_documents(spark, path), file, tokenizer("byte_bpe_50k.json"))
    return token_file.read_tokens(spark, file, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


# --- op7 ---------------------------------------------------------------------------------------

def _templates_sql() -> str:
    rows = []
    for t in licenses.TEMPLATES:
        tokens = "[" + ", ".join(f"'{w}'" for w in sorted(set(t.words))) + "]"
        phrase = "[" + ", ".join(f"'{w}'" for w in t.words) + "]"
        rows.append(f"('{t.label}', {tokens}, {phrase}, {t.threshold}, {str(t.exact).lower()}, {t.stride})")
    return "(VALUES " + ", ".join(rows) + ") AS t(label, tokens, phrase, threshold, exact, stride)"


@_query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT * FROM {_templates_sql()}),
b AS (SELECT r, stride, b * stride AS s, ws[b * stride + 1 : (b + 2) * stride] AS bw
      FROM (SELECT r, ws, stride, unnest(range(0, (len(ws) + stride - 1) // stride)) AS b FROM d, (SELECT DISTINCT stride FROM t))),
m AS (SELECT r, s, bw, label, phrase, exact, stride, len(list_intersect(tokens, bw)) / len(tokens) AS score, threshold
      FROM b JOIN t USING (stride) WHERE list_has_any(tokens, bw)),
p AS (SELECT r, label, score, exact, CASE WHEN exact THEN list_transform(list_filter(range(0, stride),
             lambda i: bw[i + 1 : i + len(phrase)] = phrase), lambda i: i + s) ELSE [] END AS places
      FROM m WHERE score >= threshold - 1e-9),
f AS (SELECT r, sum(len(places)) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
             string_agg(DISTINCT CASE WHEN exact THEN label END, ',' ORDER BY CASE WHEN exact THEN label END) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
      FROM p WHERE NOT exact OR len(places) > 0 GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(CAST(score AS DOUBLE), 0.0) AS score
FROM d LEFT JOIN f USING (r)""")
def op7_license_scan(spark: SparkSession, path: str) -> DataFrame:
    """License phrases and notices in every document."""
    found = licenses.match_templates(_documents(spark, path)).select("doc_id", "licenses.*")
    exact = F.filter("matches", lambda m: m["exact"])
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return (found.withColumn("places", F.flatten(F.transform(exact, lambda m: m["places"]))).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"), joined(exact).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score")))


# --- op8 ---------------------------------------------------------------------------------------

@_query()
def op8_near_duplicates(spark: SparkSession, path: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(_documents(spark, path)).select("doc_id", "class_id")


# --- op9 ---------------------------------------------------------------------------------------

@_query()
def op9_bpe(spark: SparkSession, path: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.encode(_documents(spark, path), tokenizer("word_bpe_49k.json"),
                      outputs=["n_tokens", "ids_sha256", "decoded_sha256"])


# --- op10 --------------------------------------------------------------------------------------

_W = substring.WIDTH


@_query(rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + {_W - 1}], ' ') AS w
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {_W - 2})) AS i FROM d)),
cut AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + {_W})) AS p FROM cut) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM d) AS a
         ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) AS g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op10_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Every document without the 50-word windows that also start in an earlier document."""
    return substring.remove_repeats(_documents(spark, path)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# --- op11 --------------------------------------------------------------------------------------

def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text; needs ``crc_table``, whose one row has the 256 remainders, in its FROM clause."""
    return (f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: "
            "xor(crc_table.t[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8), CAST(4294967295 AS BIGINT)), "
            "CAST(4294967295 AS BIGINT))")


_CRC_TABLE_SQL = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END, i)) AS t)"""


def _leaf_sql(n_chars: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in fields) + ")"


@_query(f"""
WITH RECURSIVE {_CRC_TABLE_SQL},
d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf_sql("n_chars")} AS leaf,
             CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS altered FROM documents, crc_table),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
lv AS (SELECT g, 0 AS k, i, leaf AS h, n FROM p
       UNION ALL
       SELECT g, any_value(k) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM lv WHERE n > 1 GROUP BY g, i // 2),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
up AS (SELECT 0 AS k, i, subroot AS h, n FROM s
       UNION ALL
       SELECT any_value(k) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM up WHERE n > 1 GROUP BY i // 2),
low AS (SELECT g, i, list(coalesce(x.h, '') ORDER BY k) AS path FROM (
            SELECT p.g, p.i, lv.k, max(CASE WHEN lv.i = xor(p.i >> lv.k, 1) THEN lv.h END) AS h FROM p JOIN lv
            ON lv.g = p.g AND lv.n > 1 AND lv.i IN (p.i >> lv.k, xor(p.i >> lv.k, 1)) GROUP BY ALL) AS x GROUP BY g, i),
high AS (SELECT i, list(coalesce(x.h, '') ORDER BY k) AS path FROM (
            SELECT s.i, up.k, max(CASE WHEN up.i = xor(s.i >> up.k, 1) THEN up.h END) AS h FROM s JOIN up
            ON up.n > 1 AND up.i IN (s.i >> up.k, xor(s.i >> up.k, 1)) GROUP BY ALL) AS x GROUP BY i),
f AS (SELECT p.doc_id, p.g, p.leaf, p.altered, p.i, s.subroot, s.i AS si, coalesce(low.path, []) AS lp, coalesce(high.path, []) AS hp
      FROM p JOIN s USING (g) LEFT JOIN low ON low.g = p.g AND low.i = p.i LEFT JOIN high ON high.i = s.i),
fold AS (SELECT *, list_reduce(list_zip(lp || hp, range(len(lp)) || range(len(hp)), list_transform(lp, lambda x: i) || list_transform(hp, lambda x: si)),
             lambda a, x: ROW(CASE WHEN (x[3] >> x[2]) % 2 = 1 THEN sha256(x[1] || a[1]) ELSE sha256(a[1] || x[1]) END, 0::BIGINT, 0::BIGINT),
             ROW(coalesce(altered, leaf), 0::BIGINT, 0::BIGINT)) AS folded FROM f)
SELECT doc_id, leaf, subroot, (SELECT h FROM up WHERE n = 1) AS root, sha256(array_to_string(lp || hp, '')) AS proof_sha256,
       folded[1] AS folded_root, folded[1] = (SELECT h FROM up WHERE n = 1) AS verified FROM fold""")
def op11_merkle_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what the root would be after tampering with some of them."""
    docs = _documents(spark, path)
    marked = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    fields = [F.col(c) for c in ("doc_id", "source", "lang")] + [F.col("n_chars") + 1, F.col("text")]
    rows = merkle.manifest(docs, carry={"altered": F.when(marked, merkle.digest(fields))})
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("altered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# --- op12 --------------------------------------------------------------------------------------

@_query(rf"""
WITH RECURSIVE {_CRC_TABLE_SQL},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {_crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS z
      FROM conversations, crc_table),
r AS (SELECT coalesce('=' || conv_id, '') AS g, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role,
             CASE z WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN z = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE z > 0),
n AS (SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
             row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM r),
f AS (SELECT *, left(role, 1) AS a, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM n),
turns AS (SELECT * FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) AS t(s, t)),
names AS (SELECT * FROM (VALUES (2, 'user'), (3, 'assistant')) AS t(t, role)),
kept AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS t(s, a, t)),
ins AS (SELECT s, s AS t, 0 AS cost, '' AS ops, CAST([] AS VARCHAR[]) AS lines FROM turns
        UNION ALL SELECT s, turns.t, 2, 'I', [role || ':'] FROM turns JOIN names USING (t)
        UNION ALL SELECT a.s, b.t, 4, 'II', [x.role || ':', y.role || ':'] FROM turns a JOIN turns b ON b.s = a.t
                  JOIN names x ON x.t = a.t JOIN names y ON y.t = b.t),
dp AS (SELECT g, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': 0, 'ops': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM (SELECT DISTINCT g FROM f)
       UNION ALL
       SELECT g, i + 1, t, min(next) FROM (
           SELECT dp.g, dp.i, e.t, {{'cost': best.cost + ins.cost + e.cost, 'ops': best.ops || ins.ops || e.op,
                                    'lines': best.lines || ins.lines || e.line}} AS next
           FROM dp JOIN ins ON ins.s = dp.s JOIN f ON f.g = dp.g AND f.i = dp.i + 1, LATERAL (
               SELECT ins.t AS t, 3 AS cost, 'D' AS op, CAST([] AS VARCHAR[]) AS line
               UNION ALL SELECT k.t, CASE f.fault WHEN 'truncated' THEN 1 ELSE 0 END, 'K', [f.role || ':' || f.text] FROM kept k
                         WHERE k.s = ins.t AND k.a = f.a AND f.fault IN ('', 'truncated')
               UNION ALL SELECT u.t, CASE f.fault WHEN 'truncated' THEN 3 ELSE 2 END, 'R', [m.role || ':' || f.text] FROM turns u JOIN names m USING (t)
                         WHERE u.s = ins.t AND f.fault IN ('', 'truncated')) AS e) GROUP BY g, i, t),
sizes AS (SELECT g, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
                 count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM f GROUP BY g),
pairs AS (SELECT x.g, count(*) AS illegal FROM f x JOIN f y ON y.g = x.g AND y.i = x.i + 1 WHERE x.a || y.a NOT IN ('su', 'ua', 'au') GROUP BY x.g),
done AS (SELECT dp.g, min({{'cost': best.cost + ins.cost, 'ops': best.ops || ins.ops, 'lines': best.lines || ins.lines}}) AS b
         FROM dp JOIN sizes ON sizes.g = dp.g AND sizes.n = dp.i JOIN ins ON ins.s = dp.s WHERE ins.t IN (0, 3) GROUP BY dp.g)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost,
       coalesce(b.ops, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS g FROM conversations) AS o
LEFT JOIN sizes USING (g) LEFT JOIN pairs USING (g) LEFT JOIN done USING (g)""")
def op12_conversation_repair(spark: SparkSession, path: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after planted damage."""
    rows = _table(spark, path, "conversations")
    repair = dialogue.Repair(dialogue.damage(rows))
    known = rows.select(F.struct("conv_id").alias("_conv")).distinct()
    same = lambda df, name: df.select(F.struct("conv_id").alias("_conv"), F.struct(*[c for c in df.columns if c != "conv_id"]).alias(name))
    found = known.join(same(repair.summary(), "s"), "_conv", "left").join(same(repair.digests(), "d"), "_conv", "left")
    counts = [F.coalesce(F.col(f"s.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("_conv.conv_id", *counts, F.coalesce("s.audit", F.lit("")).alias("audit"),
                        F.coalesce("d.sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# --- op13 --------------------------------------------------------------------------------------

@_query()
def op13_quality_classifier(spark: SparkSession, path: str) -> DataFrame:
    """Quality of every document; a third of the ids is held out of training."""
    docs, labels = _documents(spark, path), _table(spark, path, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = nbsvm.train(docs, labels.where(~held_out))
    return nbsvm.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
