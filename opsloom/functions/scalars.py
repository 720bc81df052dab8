"""Scalar functions on strings, numbers, arrays, maps and JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.ordered import position
from opsloom.functions.timeutil import column, micros


def composite_key(*parts: str | Column, separator: str = "#") -> Column:
    return F.concat_ws(separator, *[column(p).cast("string") for p in parts])


def strlen(c: str | Column) -> Column:
    """Length in bytes."""
    return F.octet_length(column(c))


def getrange(c: str | Column, start: int, end: int) -> Column:
    """Characters ``start..end``, both included and zero-based; negatives count from the end."""
    text = column(c)
    size = F.length(text)
    lo = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    hi = F.lit(end) if end >= 0 else size + end
    return F.substring(text, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))


def setrange(c: str | Column, offset: int, value: str) -> Column:
    """Overwrite from the zero-based ``offset`` on; a short value is first padded with zero characters."""
    padded = F.when(F.length(column(c)) < offset, F.rpad(column(c), offset, "\0")).otherwise(column(c))
    return F.overlay(padded, F.lit(value), F.lit(offset + 1))


def divide(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """Quotient and error text: division by zero is a value, not a failure."""
    left, right = column(a).cast("double"), column(b).cast("double")
    return F.try_divide(left, right), F.when(right == 0, "division by zero").otherwise("")


def client_ip(forwarded: str | Column, real_ip: str | Column, peer: str | Column) -> Column:
    """First forwarded hop, else the real-ip header, else the peer, else ``unknown``; empty counts as missing."""
    present = lambda c: F.when(column(c) != "", column(c))
    first_hop = F.trim(F.get(F.split(present(forwarded), ","), 0))
    return F.coalesce(first_hop, present(real_ip), present(peer), F.lit("unknown"))


def array_where(c: str | Column, field: str, value: object) -> Column:
    """``[?field == value]`` over an array of structs."""
    return F.filter(column(c), lambda s: s[field] == F.lit(value))


def has_tag(c: str | Column, key: str, value: object) -> Column:
    return F.exists(column(c), lambda s: (s["Key"] == F.lit(key)) & (s["Value"] == F.lit(value)))


def project_field(c: str | Column, field: str) -> Column:
    return F.transform(column(c), lambda s: s[field])


def hset_if_absent(m: str | Column, key: str, value: Column) -> Column:
    fields = column(m)
    return F.when(F.map_contains_key(fields, key), fields).otherwise(F.map_concat(fields, F.create_map(F.lit(key), value)))


def hdel(m: str | Column, *keys: str) -> Column:
    return F.map_filter(column(m), lambda k, _: ~k.isin(list(keys)))


def hmget(m: str | Column, keys: Sequence[str]) -> Column:
    """Values in the order of ``keys``; null for an absent key."""
    fields = column(m)
    return F.array(*[fields[k] for k in keys])


def data_map(m: str | Column, drop: Sequence[str]) -> Column:
    """The remaining fields of an entry."""
    return hdel(m, *drop)


def json_get(c: str | Column, path: str) -> Column:
    return F.get_json_object(column(c), path)


def json_set(c: str | Column, schema: str, changes: Mapping[str, Column]) -> Column:
    """Partial update at paths such as ``detail.state`` of a JSON text with a known schema."""
    doc = F.from_json(column(c), schema)
    for path, value in changes.items():
        doc = doc.withField(path, value)
    return F.to_json(doc)


def string_fields(columns: Mapping[str, Column]) -> Column:
    """All-string field map of a stream entry; booleans read ``true``/``false``."""
    pairs = [item for name, value in columns.items() for item in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs)


def time_key(key: str | Column, ts: str | Column, pattern: str = "yyyy-MM-dd", prefix: str = "DEVICE") -> Column:
    """``DEVICE#100#2026-07-23``."""
    return F.concat_ws("#", F.lit(prefix), column(key).cast("string"), F.date_format(column(ts), pattern))


def sequence_id(df: DataFrame, ts: str, order: Sequence[str], chunk: Column, out: str = "id") -> DataFrame:
    """``{ms}-{n}`` with n counting from 0 inside each millisecond."""
    placed = position(df.withColumn("_ms", F.floor(micros(ts) / 1000)), ["_ms"], order, chunk, "_n")
    return placed.withColumn(out, F.concat_ws("-", F.col("_ms").cast("string"), F.col("_n").cast("string"))).drop("_ms", "_n")


def greeting(word: str | Column, name: str | Column) -> Column:
    return F.concat_ws(" ", column(word), column(name))


def greetings(df: DataFrame, word: str, name: str, times: int = 3) -> DataFrame:
    """Each row answered ``times`` times, numbered from 1."""
    numbered = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return numbered.withColumn("reply", F.concat_ws(" ", word, name, F.col("n").cast("string")))


def url_parts(c: str | Column) -> dict[str, Column]:
    url = column(c)
    return {"scheme": F.try_parse_url(url, F.lit("PROTOCOL")), "host": F.try_parse_url(url, F.lit("HOST")),
            "path": F.try_parse_url(url, F.lit("PATH")), "query": F.try_parse_url(url, F.lit("QUERY"))}
