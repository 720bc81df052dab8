"""Projections and row filters (B1-B29). Everything stays a Column, so Parquet sees the predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions import patterns
from opsloom.functions.hashing import key_partition, stable_hash
from opsloom.functions.ordered import first_n
from opsloom.functions.timeutil import column, floor_time, ntz

# Patterns of the access-log checks.
STATIC_ASSET = r"\.(css|js|png|jpg|svg|ico|woff)"
BOT_AGENT = r"(?i)bot|crawler|spider|scraper"
TOOL_AGENT = r"curl|wget|python|scrapy"
SENSITIVE_PATH = r"/(admin|wp-admin|phpmyadmin|\.env|\.git|wp-login)"


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def project_paths(df: DataFrame, paths: Mapping[str, str]) -> DataFrame:
    """``{"city": "address.city", "first": "tags[0]"}``; a missing list element is null."""
    picked = []
    for out, path in paths.items():
        if path.endswith("]"):
            base, index = path[:-1].rsplit("[", 1)
            picked.append(F.get(F.col(base), int(index)).alias(out))
        else:
            picked.append(F.col(path).alias(out))
    return df.select(*picked)


def where_cmp(df: DataFrame, c: str, op: str, value: object) -> DataFrame:
    return df.where(patterns.COMPARE[op](F.col(c), F.lit(value)))


def where_between(df: DataFrame, c: str, low: object, high: object) -> DataFrame:
    return df.where(F.col(c).between(low, high))


def where_in(df: DataFrame, c: str, values: Sequence[object]) -> DataFrame:
    return df.where(F.col(c).isin(list(values)))


def where_prefix(df: DataFrame, c: str, prefix: str) -> DataFrame:
    return df.where(F.col(c).startswith(prefix))


def where_contains(df: DataFrame, c: str, value: object) -> DataFrame:
    """Substring of a string column, member of an array column."""
    if df.schema[c].dataType.typeName() == "array":
        return df.where(F.array_contains(c, value))
    return df.where(F.col(c).contains(value))


def where_exists(df: DataFrame, c: str, key: str | None = None, exists: bool = True) -> DataFrame:
    """Presence of a map key (a present null counts) or of a column value."""
    found = F.map_contains_key(F.col(c), key) if key is not None else F.col(c).isNotNull()
    return df.where(found if exists else ~found)


def where_type(df: DataFrame, json_col: str, path: str, kind: str) -> DataFrame:
    """Rows whose JSON value at ``path`` has the type ``kind`` (BIGINT, STRING, BOOLEAN, ...)."""
    value = F.try_variant_get(F.try_parse_json(F.col(json_col)), path, "variant")
    return df.where(F.schema_of_variant(value) == kind)


def where_size(df: DataFrame, c: str, op: str, n: int) -> DataFrame:
    text = df.schema[c].dataType.typeName() == "string"
    return df.where(patterns.COMPARE[op](F.length(c) if text else F.size(c), n))


def where_like(df: DataFrame, c: str, regex: str, negate: bool = False) -> DataFrame:
    hit = F.col(c).rlike(regex)
    return df.where(~hit if negate else hit)


def where_status(df: DataFrame, low: int, high: int, c: str = "status") -> DataFrame:
    return df.where(F.col(c).between(low, high))


def where_day(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Half-open range on the raw column, which Parquet row groups can be skipped by."""
    start = ntz(day)
    return df.where((F.col(ts) >= start) & (F.col(ts) < start + F.expr("INTERVAL 1 DAY")))


def where_last(df: DataFrame, date: str, days: int, as_of: str) -> DataFrame:
    """Rows dated at or after ``as_of - days``."""
    return df.where(F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), days))


def churned(customers: DataFrame, last_active: str, segment: str, as_of: str, days: int = 90) -> DataFrame:
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days)
    return (customers.where(F.col(last_active) < cutoff).groupBy(segment)
            .agg(F.count(F.lit(1)).alias("churned")))


def exclude_static(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(~F.col(path).rlike(STATIC_ASSET))


def bots_by_ip(df: DataFrame, agent: str = "agent", client: str = "client") -> DataFrame:
    return df.where(F.col(agent).rlike(BOT_AGENT)).groupBy(client).agg(F.count(F.lit(1)).alias("requests"))


def suspicious_agents(df: DataFrame, agent: str = "agent") -> DataFrame:
    """Rows whose agent is exactly ``-`` or names a scripting tool."""
    return df.where((F.col(agent) == "-") | F.col(agent).rlike(TOOL_AGENT))


def sensitive_paths(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(F.col(path).rlike(SENSITIVE_PATH))


def slow_requests(df: DataFrame, seconds: float = 2.0, rt: str = "rt", inclusive: bool = False) -> DataFrame:
    return df.where(F.col(rt) >= seconds if inclusive else F.col(rt) > seconds)


def select_labels(df: DataFrame, selector: str, labels: str = "labels") -> DataFrame:
    return df.where(patterns.label_selector(selector, F.col(labels)))


def match_policy(df: DataFrame, policy: Mapping, attributes: str | None = None, body: str | None = None) -> DataFrame:
    """Rows a filter policy accepts; attributes are columns, a map column or a JSON body."""
    if attributes is not None:
        fields = lambda path: F.col(attributes)[path]
    elif body is not None:
        fields = patterns.json_fields(F.col(body))
    else:
        fields = patterns.column_fields(df)
    return df.where(patterns.policy(policy, fields))


def metric_filter(df: DataFrame, pattern: str, message: str = "message") -> DataFrame:
    return df.where(patterns.metric_pattern(pattern, F.col(message)))


def sample_by_key(df: DataFrame, key: str, percent: int) -> DataFrame:
    """Deterministic: the same key is always in or always out."""
    return df.where(key_partition(key, 100) < percent)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in a seeded hash order (random member); the rest is ``pop_rest``."""
    return df.orderBy(stable_hash(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), key).limit(n)


def pop_rest(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.join(sample_n(df, key, n, seed).select(key), key, "left_anti")


def redact(df: DataFrame, rules: Mapping[str, str | tuple[str, str]]) -> DataFrame:
    """Per column: ``mask``, ``hash``, ``strip_query`` or a (regex, replacement) pair."""
    changed: dict[str, Column] = {}
    for name, rule in rules.items():
        c = F.col(name)
        if rule == "mask":
            changed[name] = F.mask(c)
        elif rule == "hash":
            changed[name] = F.sha2(c, 256)
        elif rule == "strip_query":
            changed[name] = F.substring_index(c, "?", 1)
        else:
            changed[name] = F.regexp_replace(c, *rule)
    return df.withColumns(changed)


def drilldown(df: DataFrame, predicate: Column, cols: Sequence[str], ts: str, tie: str, n: int) -> DataFrame:
    """Newest ``n`` matching rows."""
    return df.where(predicate).orderBy(F.desc(ts), F.desc(tie)).limit(n).select(*cols)


def live(df: DataFrame, ttl: str, now: str | Column) -> DataFrame:
    """Rows without an expiry or with one in the future; expiry itself is asynchronous."""
    moment = ntz(now) if isinstance(now, str) else now
    return df.where(F.col(ttl).isNull() | (F.col(ttl) > moment))


def valid_rows(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with the names of the failed rules."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    checked = df.withColumn("failed_rules", F.array_join(failed, ","))
    return (checked.where(F.col("failed_rules") == "").drop("failed_rules"),
            checked.where(F.col("failed_rules") != ""))


def reservoir_sample(df: DataFrame, ts: str, row_id: str, reservoir: int, percent: int) -> DataFrame:
    """First ``reservoir`` rows of every second, plus ``percent`` of the others by hash.

    The hash part is a plain filter; only the first rows of each second are shuffled.
    """
    picked = key_partition(row_id, 100) < percent
    seconds = df.withColumn("_second", floor_time(column(ts), "second"))
    certain = first_n(seconds, ["_second"], [F.col(ts), F.col(row_id)], reservoir, F.col(row_id))
    return df.where(picked).unionByName(certain.drop("_second", "rn").where(~picked))
