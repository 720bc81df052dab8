"""Table changes as DataFrame merges (I1-I20). Every function returns new tables; nothing is updated in place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.ordered import first_n, running_sum, slots
from opsloom.functions.patterns import glob_regex
from opsloom.functions.timeutil import micros, ntz
from opsloom.operators.ranking import latest_by


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def patch(df: DataFrame, changes: DataFrame, key: str, updated: str | None = None) -> DataFrame:
    """Partial update. ``changes(key, fields map<string,string>[, updated])`` has one row per key.

    Only supplied fields change: a field missing from the map keeps its value, a field
    mapped to null becomes null. The update time moves for every changed row.
    """
    extra = [F.col(updated).alias("_updated")] if updated else []
    joined = df.join(changes.select(key, F.col("fields").alias("_fields"), *extra), key, "left")
    merged = {}
    for field in df.schema.fields:
        if field.name == key:
            continue
        if field.name == updated:
            merged[updated] = F.coalesce("_updated", updated)
        else:
            given = F.coalesce(F.map_contains_key("_fields", field.name), F.lit(False))
            merged[field.name] = F.when(given, F.col("_fields")[field.name].cast(field.dataType)).otherwise(F.col(field.name))
    return joined.withColumns(merged).select(*df.columns)


def upsert(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace stored rows of the same key (one incoming row per key)."""
    return df.join(rows.select(key), key, "left_anti").unionByName(rows)


def put_if_absent(df: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Only new keys are added; inside the batch the first row of a key wins."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")
    fresh = first.join(df.select(key), key, "left_anti")
    return df.unionByName(fresh.select(*df.columns))


def decrement_if(stock: DataFrame, requests: DataFrame, key: str, quantity: str, order: Sequence[str], chunk: Column) -> DataFrame:
    """Requests with ``accepted``: one unit each while stock remains, never below zero.

    A running count is exact because all requests are for one unit; requests of mixed
    sizes need ``limits.decrement_by``.
    """
    asked = running_sum(requests, [key], order, chunk, {"_asked": F.lit(1)})
    return (asked.join(stock.select(key, quantity), key, "left")
            .withColumn("accepted", F.col("_asked") <= F.coalesce(F.col(quantity), F.lit(0))).drop("_asked", quantity))


def apply_versioned(df: DataFrame, writes: DataFrame, key: str, version: str, value: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Optimistic check: the first write that names the stored version wins, all others are rejected."""
    current = df.select(key, F.col(version).alias("_current"))
    judged = writes.join(current, key, "left").withColumn("_match", F.coalesce(F.col(version) == F.col("_current"), F.lit(False)))
    winner = (judged.where("_match").groupBy(key)
              .agg(F.min_by(F.struct(F.col(value).alias("_new"), *order), F.struct(*order)).alias("_win")))
    table = df.join(winner, key, "left").select(
        key, *[F.when(F.col("_win").isNotNull(), F.col(version) + 1).otherwise(F.col(version)).alias(c) if c == version
               else F.when(F.col("_win").isNotNull(), F.col("_win._new")).otherwise(F.col(c)).alias(c)
               for c in df.columns if c != key])
    same = F.struct(*order) == F.struct(*[F.col(f"_win.{c}") for c in order])
    rejects = (judged.join(winner, key, "left").where(~F.col("_match") | ~F.coalesce(same, F.lit(False)))
               .select(*writes.columns))
    return table, rejects


def apply_batch(df: DataFrame, ops: DataFrame, key: str, op: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Batch of ``put``/``delete`` without atomicity, and the unprocessed operations.

    Unprocessed: an unknown operation, no key, or a key named again within the batch.
    """
    valid = F.col(op).isin("put", "delete") & F.col(key).isNotNull()
    first = ops.where(valid).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    tagged = ops.join(first, key, "left").withColumn(
        "_ok", F.coalesce(valid & (F.struct(*order) == F.col("_first")), F.lit(False))).drop("_first")
    done = tagged.where("_ok").drop("_ok")
    puts = done.where(F.col(op) == "put").select(*df.columns)
    table = df.join(done.select(key), key, "left_anti").unionByName(puts)
    return table, tagged.where(~F.col("_ok")).drop("_ok")


def validate_cart(requests: DataFrame, products: DataFrame, key: str, quantity: str, stock: str, unknown: str = "unknown product",
                  short: str = "not enough in stock") -> DataFrame:
    """Requests with an ``error`` text (empty when acceptable)."""
    joined = requests.join(products.select(key, stock, F.lit(True).alias("_known")), key, "left")
    error = F.when(F.col("_known").isNull(), unknown).when(F.col(stock) < F.col(quantity), short).otherwise("")
    return joined.withColumn("error", error).drop("_known", stock)


# --- keyed logs -------------------------------------------------------------------------------

def compact(log: DataFrame, key: str, offset: str, value: str) -> DataFrame:
    """Latest record per key; tombstones (null values) and records without key disappear."""
    return latest_by(log.where(F.col(key).isNotNull()), [key], [offset]).where(F.col(value).isNotNull())


def compact_and_delete(log: DataFrame, key: str, offset: str, value: str, ts: str, as_of: str, keep_seconds: float) -> DataFrame:
    return retain_age(compact(log, key, offset, value), ts, as_of, keep_seconds)


def retain_age(log: DataFrame, ts: str, as_of: str, keep_seconds: float) -> DataFrame:
    """Rows no older than ``keep_seconds``; the bound sits on the raw column, so scans can skip."""
    limit = F.timestamp_add("MICROSECOND", F.lit(-int(keep_seconds * 1_000_000)), ntz(as_of))
    return log.where(F.col(ts) >= limit)


def retain_bytes(log: DataFrame, partition: str, offset: str, size: Column, max_bytes: int, chunk_width: int = 1_000_000,
                 fan: int = 1000) -> DataFrame:
    """Newest rows of each partition whose total size fits; row-level, not segment-level.

    Sizes are summed per chunk of ``chunk_width`` offsets and per run of ``fan`` chunks, so one row per ``chunk_width * fan``
    offsets of a hot partition meets in a task.
    """
    newest_first = log.withColumn("_back", -F.col(offset))
    summed = running_sum(newest_first, [partition], ["_back"], slots("_back", chunk_width), {"_bytes": size}, fan)
    return summed.where(F.col("_bytes") <= max_bytes).drop("_back", "_bytes")


def ttl_seconds(df: DataFrame, expires: str, now: str) -> DataFrame:
    """Remaining seconds: -1 without an expiry, -2 when gone."""
    left = (micros(expires) - micros(ntz(now))) / 1_000_000
    return df.withColumn("ttl", F.when(F.col(expires).isNull(), -1).when(left <= 0, -2).otherwise(F.floor(left)).cast("bigint"))


def delete_matching(df: DataFrame, key: str, glob: str) -> DataFrame:
    return df.where(~F.col(key).rlike(glob_regex(glob)))


def expire_carts(carts: DataFrame, cart: str, activity: str, as_of: str, days: int) -> DataFrame:
    """Rows of carts whose last activity is within ``days``."""
    limit = ntz(as_of) - F.make_dt_interval(F.lit(days))
    alive = carts.groupBy(cart).agg(F.max(activity).alias("_last")).where(F.col("_last") >= limit)
    return carts.join(alive.select(cart), cart, "left_semi")


def apply_changes(base: DataFrame, changes: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """Fold a change stream into a table: the last change per key decides."""
    last = latest_by(changes, [key], [seq])
    written = last.where(F.col(op) != "REMOVE").select(*base.columns)
    return base.join(last.select(key), key, "left_anti").unionByName(written)


def diff(changes: DataFrame, keys: Sequence[str], old: str, new: str) -> DataFrame:
    """One row per changed field of each change record (images are string maps)."""
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_zip_with(F.coalesce(F.col(old), empty), F.coalesce(F.col(new), empty),
                            lambda _, a, b: F.struct(a.alias("old"), b.alias("new")))
    changed = F.map_filter(merged, lambda _, pair: ~pair["old"].eqNullSafe(pair["new"]))
    return changes.select(*keys, F.explode(changed).alias("field", "_pair")).select(*keys, "field", "_pair.old", "_pair.new")


def index_view(df: DataFrame, keys: Sequence[str], kind: str, include: Sequence[str] = ()) -> DataFrame:
    """Sparse index: rows that have the index keys, projected KEYS_ONLY, INCLUDE or ALL."""
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    columns = {"KEYS_ONLY": keys, "INCLUDE": [*keys, *include], "ALL": df.columns}[kind]
    return present.select(*columns)


def refresh(summary: DataFrame, path: str) -> DataFrame:
    """Store a summary table and return the stored copy."""
    summary.write.mode("overwrite").parquet(path)
    return summary.sparkSession.read.schema(summary.schema).parquet(path)


# --- object lifecycle -------------------------------------------------------------------------

def lifecycle_plan(inventory: DataFrame, rules: Sequence[Mapping], as_of: str) -> DataFrame:
    """Action per object: ``expire``, ``transition:CLASS`` or ``keep``.

    A rule has any of prefix, tag, min_size, and transition (days, class) or expire_days.
    Expiry beats transition; of several transitions the one with most days wins.
    """
    age = F.datediff(F.lit(as_of).cast("date"), F.col("modified").cast("date"))
    options = []
    for rule in rules:
        fits = F.lit(True)
        if "prefix" in rule:
            fits = fits & F.col("key").startswith(rule["prefix"])
        if "tag" in rule:
            fits = fits & (F.col("tag") == rule["tag"])
        if "min_size" in rule:
            fits = fits & (F.col("size") >= rule["min_size"])
        for days, target in rule.get("transitions", []):
            options.append(F.when(fits & (age >= days), F.struct(F.lit(1).alias("rank"), F.lit(days).alias("days"),
                                                                 F.lit("transition:" + target).alias("action"))))
        if "expire_days" in rule:
            options.append(F.when(fits & (age >= rule["expire_days"]),
                                  F.struct(F.lit(2).alias("rank"), F.lit(rule["expire_days"]).alias("days"), F.lit("expire").alias("action"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return inventory.withColumn("action", F.coalesce(best["action"], F.lit("keep")))


def noncurrent_cleanup(versions: DataFrame, key: str, order: Sequence[str], version_id: str, keep: int) -> DataFrame:
    """Version rows to delete: all but the current one and the newest ``keep`` non-current ones."""
    kept = first_n(versions, [key], [F.desc(c) for c in order], keep + 1, F.col(version_id), out="_rn")
    return versions.join(kept.select(version_id), version_id, "left_anti")
