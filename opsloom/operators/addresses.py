"""Address prefixes as disjoint ranges: IPv4 and IPv6, longest prefix wins.

An address becomes a key of fixed length, its family and its hexadecimal digits, so keys sort as addresses do. Nested prefixes
are swept into boundaries: from each one up to the next, one prefix (or none) is the longest that holds an address. Addresses
are then placed by one sort with the boundaries and a carry of the last boundary; no address is expanded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.ordered import last_seen
from opsloom.functions.timeutil import column
from opsloom.operators.joins import ipv4
from opsloom.session import cut_lineage

# Family digit and number of hexadecimal digits.
FAMILIES = {"4": 8, "6": 32}


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _plain(text: Column) -> Column:
    """An IPv6 address whose dotted IPv4 tail, if any, is two groups of digits; null if the tail is malformed."""
    tail = F.substring_index(text, ":", -1)
    head = F.left(text, F.length(text) - F.length(tail))
    dotted = _let(ipv4(tail), lambda v: F.concat(head, F.lower(F.hex(F.shiftright(v, 16))), F.lit(":"), F.lower(F.hex(v.bitwiseAND(F.lit(65535))))))
    return F.when(tail.contains("."), dotted).otherwise(text)


def _groups(halves: Column) -> Column:
    """Eight groups from the parts before and after ``::``; null if there are too many or too few."""
    part = lambda i: F.filter(F.split(F.coalesce(F.get(halves, i), F.lit("")), ":"), lambda g: F.get(halves, i) != "")
    zeros = 8 - F.size(part(0)) - F.size(part(1))
    return F.when((F.size(halves) == 2) & (zeros > 0), F.concat(part(0), F.array_repeat(F.lit("0"), zeros), part(1))).when(
        (F.size(halves) == 1) & (zeros == 0), part(0))


def _ipv6_digits(address: Column) -> Column:
    """The 32 digits of an IPv6 address, or null. A dotted IPv4 tail and one ``::`` are understood; zones are not."""
    joined = lambda g: F.when(F.forall(g, lambda d: d.rlike("^[0-9a-f]{1,4}$")),
                              F.array_join(F.transform(g, lambda d: F.lpad(d, 4, "0")), ""))
    return _let(F.lower(address), lambda text: _let(F.split(_plain(text), "::"), lambda halves: _let(_groups(halves), joined)))


def ip_key(address: str | Column) -> Column:
    """``4`` and 8 digits or ``6`` and 32 digits; null when malformed. All spellings of an address have one key."""
    c = column(address)
    return F.when(c.contains(":"), F.concat(F.lit("6"), _ipv6_digits(c))).otherwise(F.concat(F.lit("4"), _hex(ipv4(c), 8)))


def _edge(key: Column, bits: Column, top: bool) -> Column:
    """First (or last) key of the prefix of ``bits`` bits that holds ``key``."""
    whole = F.floor(bits / 4).cast("int")
    free = F.pow(F.lit(2), 4 - bits % 4).cast("bigint")
    digit = F.conv(F.substring(key, whole + 2, F.lit(1)), 16, 10).cast("bigint")
    low = digit - digit % free
    edge = F.when(bits % 4 == 0, "").otherwise(F.lower(F.hex(low + free - 1 if top else low)))
    return F.rpad(F.concat(F.left(key, whole + 1), edge), F.length(key), F.lit("f" if top else "0"))


def prefix_boundaries(inventory: DataFrame, fields: Sequence[str], cidr: str = "cidr") -> DataFrame:
    """``point`` and ``owner``: from ``point`` up to the next one, ``owner`` (``prefix_len`` and ``fields``) is the longest prefix; null: none.

    A table to be stored: at most two rows per distinct prefix. Prefixes that are malformed, or longer than their family allows,
    hold nothing; digits behind a prefix's length are ignored. Of equal prefixes the one with the greatest fields counts.
    Only the inventory is expanded here, to the lengths it uses, to find the prefix around each prefix.
    """
    key, bits = ip_key(F.substring_index(cidr, "/", 1)), F.substring_index(cidr, "/", -1).try_cast("int")
    # Arrays between parse and use keep the parsed values from being put in again wherever they are named.
    parsed = inventory.where(F.col(cidr).contains("/")).select(F.explode(F.array(key)).alias("_key"), bits.alias("prefix_len"), *fields)
    size = F.when(F.left("_key", F.lit(1)) == "4", 32).otherwise(128)
    parsed = parsed.where(F.col("_key").isNotNull() & F.col("prefix_len").between(0, size))
    length = F.col("prefix_len")
    span = F.struct(_edge(F.col("_key"), length, False).alias("_low"), _edge(F.col("_key"), length, True).alias("_last"))
    nets = (parsed.select("*", F.inline(F.array(span)))
            .groupBy("_low", "prefix_len").agg(F.any_value("_last").alias("_last"), F.max(F.struct("prefix_len", *fields)).alias("owner")))
    lengths = nets.agg(F.collect_set("prefix_len").alias("_lengths"))
    wider = (nets.select("_low", "prefix_len", F.explode(lengths.scalar()).alias("_wide")).where("_wide < prefix_len")
             .withColumn("_around", _edge(F.col("_low"), F.col("_wide"), False)))
    around = nets.select(F.col("_low").alias("_around"), F.col("prefix_len").alias("_wide"), F.col("owner").alias("_outer"))
    parents = (wider.join(around, ["_around", "_wide"]).groupBy("_low", "prefix_len").agg(F.max_by("_outer", "_wide").alias("_outer")))
    both = nets.join(parents, ["_low", "prefix_len"], "left")
    # ``last~`` lies between the last key and the key after it. Where several prefixes end, the widest one's surroundings count.
    edges = F.array(F.struct(F.col("_low").alias("point"), length.alias("rank"), F.col("owner").alias("owner")),
                    F.struct(F.concat("_last", F.lit("~")).alias("point"), (-length).alias("rank"), F.col("_outer").alias("owner")))
    ends = both.select(F.inline(edges))
    # A struct around the owner, since ``max_by`` would keep a null one as well as any other.
    return ends.groupBy("point").agg(F.max_by(F.struct("owner"), "rank").alias("_best")).select("point", "_best.owner")


def place_addresses(addresses: DataFrame, address: str, boundaries: DataFrame) -> DataFrame:
    """Distinct well-formed addresses and the ``owner`` whose range holds them (null: none).

    Addresses and boundaries are sorted together, by range; the last boundary of each sorted part is carried to the next.
    Addresses of one subnet, however many, are spread over as many parts as they need.
    """
    keys = addresses.select(address).distinct().select(F.explode(F.array(ip_key(address))).alias("point"), F.lit(1).alias("_side"), F.col(address).alias("_address"))
    keys = keys.where(F.col("point").isNotNull()).withColumn("owner", F.lit(None).cast(boundaries.schema["owner"].dataType))
    edges = boundaries.select("point", F.lit(0).alias("_side"), F.lit(None).cast(addresses.schema[address].dataType).alias("_address"), "owner")
    stacked = cut_lineage(edges.unionByName(keys).orderBy("point", "_side").withColumn("_part", F.shiftrightunsigned(F.monotonically_increasing_id(), 33)))
    family = stacked.withColumn("_family", F.left("point", F.lit(1)))
    found = last_seen(family, ["_family"], ["point", "_side"], F.col("_part"), F.col("_side") == 0, {"_owner": F.col("owner")})
    return found.where("_side = 1").select(F.col("_address").alias(address), F.col("_owner").alias("owner"))


def enrich_addresses(rows: DataFrame, address: str, boundaries: DataFrame) -> DataFrame:
    """``rows`` with the fields of the longest prefix that holds ``address``; null fields outside all prefixes."""
    fields = boundaries.schema["owner"].dataType.fieldNames()
    owners = place_addresses(rows, address, boundaries).where(F.col("owner").isNotNull()).select(address, *[f"owner.{f}" for f in fields])
    return rows.join(owners, address, "left")
