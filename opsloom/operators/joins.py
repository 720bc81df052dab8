"""Joins and enrichment.

No broadcast hints: Spark broadcasts a side only when its size is known to be small, and
falls back to a shuffle join (with AQE skew splitting) when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.ordered import last_seen
from opsloom.functions.timeutil import column, micros, time_chunk


def star_join(fact: DataFrame, chosen: Column, dimensions: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """A filtered fact row with its dimensions, each given as (fact key, dimension, dimension key).

    The filter reaches the fact scan first, so only the chosen rows meet the dimensions.
    """
    rows = fact.where(chosen)
    for fact_key, dimension, key in dimensions:
        rows = rows.join(dimension, F.col(fact_key) == F.col(key)).drop(*([key] if key != fact_key else []))
    return rows


def product_summary(products: DataFrame, reviews: DataFrame, stock: DataFrame) -> DataFrame:
    """Average rating (0 without reviews) and review count per product.

    Reviews are reduced per product before the join, so a second stock row cannot
    multiply them and a hot product joins as a single row.
    """
    rated = reviews.groupBy("product_id").agg(
        (F.sum("rating").cast("double") / F.count("rating")).alias("avg_rating"), F.count("rating").alias("review_count"))
    return (products.join(rated, "product_id", "left").join(stock, "product_id", "left")
            .fillna({"avg_rating": 0.0, "review_count": 0}))


def where_exists_in(left: DataFrame, right: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    """Left semi join: the common meaning of ``EXISTS`` and ``IN``."""
    return left.join(right, on, "left_semi")


def bloom_prefilter(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows whose key is a member of ``right``.

    The semi join is exact. Spark's runtime Bloom filter (``spark.sql.optimizer.runtime.bloomFilter``)
    drops most non-members before the shuffle and never a member.
    """
    return left.join(right.select(on), on, "left_semi")


def enrich_names(df: DataFrame, dim: DataFrame, key: str, name: str, label: str = "Product ") -> DataFrame:
    """Lookup with a default label for unknown keys."""
    return (df.join(dim.select(key, name), key, "left")
            .withColumn(name, F.coalesce(F.col(name), F.concat(F.lit(label), F.col(key).cast("string")))))


def batch_get(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys; an absent key gives no row, a repeated one no second row."""
    return df.join(keys.select(key), key, "left_semi")


def related(bridge: DataFrame, far: DataFrame, near_key: str, far_key: str, near_id: object) -> DataFrame:
    """Far side of a many-to-many relation for one near-side id."""
    return far.join(bridge.where(F.col(near_key) == near_id).select(far_key).distinct(), far_key, "left_semi")


def new_only(batch: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Records not processed before."""
    return batch.join(seen.select(key), key, "left_anti")


def drift(observed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed edges that the expected topology does not list."""
    return observed.select(*keys).distinct().join(expected, list(keys), "left_anti")


def correlate(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Full outer join on a request id, with the layers that saw each request."""
    a = left.withColumn("_a", F.lit(names[0]))
    b = right.withColumn("_b", F.lit(names[1]))
    return a.join(b, key, "full_outer").withColumn("present_in", F.concat_ws("+", "_a", "_b")).drop("_a", "_b")


# --- addresses --------------------------------------------------------------------------------

def ipv4(address: str | Column) -> Column:
    """Dotted address as a long; null when malformed."""
    parts = F.split(column(address), r"\.")
    octets = [F.get(parts, i).try_cast("bigint") for i in range(4)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    valid = F.size(parts) == 4
    for octet in octets:
        valid = valid & octet.between(0, 255)
    return F.when(valid, value)


def cidr_match(addresses: DataFrame, address: str, inventory: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(address, prefix_len, *fields)`` of the longest matching prefix.

    Works on distinct addresses: each is parsed once, expands to one row per prefix length in use (33 at most) and meets the
    inventory in one equi-join on (length, network). Inventory rows of other address families or with malformed networks
    match nothing, and neither do malformed addresses.
    """
    nets = inventory.select(F.substring_index("cidr", "/", -1).cast("int").alias("prefix_len"),
                            ipv4(F.substring_index("cidr", "/", 1)).alias("_ip"), *fields)
    shifted = lambda ip: F.floor(ip / F.pow(F.lit(2.0), F.lit(32) - F.col("prefix_len"))).cast("bigint")
    nets = nets.withColumn("_net", shifted(F.col("_ip"))).drop("_ip")
    nets = nets.where(F.col("prefix_len").between(0, 32) & F.col("_net").isNotNull())
    lengths = nets.agg(F.collect_set("prefix_len").alias("_lengths"))
    # The array between parse and use keeps the parsed address from being put in again wherever it is named.
    probes = (addresses.select(address).distinct().withColumn("_ip", F.explode(F.array(ipv4(address))))
              .withColumn("prefix_len", F.explode(lengths.scalar())).withColumn("_net", shifted(F.col("_ip"))).drop("_ip"))
    packed = F.struct("prefix_len", *fields)
    best = probes.join(nets, ["prefix_len", "_net"]).groupBy(address).agg(F.max_by(packed, "prefix_len").alias("_best"))
    return best.select(address, "_best.*")


def cidr_enrich(flows: DataFrame, address: str, inventory: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Longest-prefix enrichment; addresses outside the inventory get null fields (external)."""
    return flows.join(cidr_match(flows, address, inventory, fields), address, "left")


def traffic_scope(flows: DataFrame, inventory: DataFrame, owner: str = "owner") -> DataFrame:
    """East-west, outbound, inbound or external traffic, from the owners of both ends."""
    ends = flows.select("srcaddr").union(flows.select("dstaddr")).distinct().toDF("address")
    owners = cidr_match(ends, "address", inventory, [owner]).drop("prefix_len")
    tagged = (flows.join(owners.withColumnsRenamed({"address": "srcaddr", owner: "src_owner"}), "srcaddr", "left")
              .join(owners.withColumnsRenamed({"address": "dstaddr", owner: "dst_owner"}), "dstaddr", "left"))
    src, dst = F.col("src_owner").isNotNull(), F.col("dst_owner").isNotNull()
    scope = F.when(src & dst, "east-west").when(src, "outbound").when(dst, "inbound").otherwise("external")
    return tagged.withColumn("scope", scope)


def exfil_hints(flows: DataFrame, inventory: DataFrame, min_bytes: float, expected_ports: Sequence[int]) -> DataFrame:
    """Outbound pairs that moved many bytes or used an unexpected port (limits are ours)."""
    out = traffic_scope(flows, inventory).where(F.col("scope") == "outbound")
    odd = ~F.col("dstport").isin(list(expected_ports))
    pairs = out.groupBy("srcaddr", "dstaddr").agg(F.sum("bytes").alias("total_bytes"), F.max(odd).alias("unexpected_port"))
    return pairs.where((F.col("total_bytes") >= min_bytes) | F.col("unexpected_port"))


# --- as-of ------------------------------------------------------------------------------------

def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, right_id: str, fields: Sequence[str],
              tolerance_seconds: float | None = None, chunk_seconds: float = 86400) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time.

    Both sides are stacked and ordered together, so this is one shuffle with no range join;
    a right row sorts before a left row of equal time. Left rows without a time stay and match nothing; right rows
    without one are never matched; null keys match null keys.
    """
    picked = [f.name for f in left.schema.fields if f.name not in keys and f.name != ts]
    a = left.select(*keys, ts, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_id].dataType).alias("_rid"),
                    F.struct(*picked).alias("_left"), *[F.lit(None).cast(right.schema[f].dataType).alias(f"_r_{f}") for f in fields])
    empty = F.lit(None).cast(a.schema["_left"].dataType)
    b = right.where(F.col(ts).isNotNull()).select(*keys, ts, F.lit(0).alias("_side"), F.col(right_id).alias("_rid"), empty.alias("_left"),
                     *[F.col(f).alias(f"_r_{f}") for f in fields])
    values = {"_rts": F.col(ts), **{f: F.col(f"_r_{f}") for f in fields}}
    found = last_seen(a.unionByName(b), keys, [ts, "_side", "_rid"], time_chunk(ts, chunk_seconds), F.col("_side") == 0, values)
    result = found.where("_side = 1")
    if tolerance_seconds is not None:
        fresh = micros(ts) - micros("_rts") <= int(tolerance_seconds * 1_000_000)
        result = result.withColumns({f: F.when(fresh, F.col(f)) for f in fields})
    return result.select(*keys, ts, "_left.*", *fields)
