"""Scans and parsers (A1-A11). Schemas are always explicit; nothing is inferred from the data."""

from __future__ import annotations

import itertools
import re
from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opsloom.functions.patterns import glob_capture
from opsloom.functions.timeutil import from_micros

# Field order of a version 5 network flow record.
FLOW_SCHEMA = """version int, account_id string, interface_id string, srcaddr string, dstaddr string, srcport int,
dstport int, protocol bigint, packets bigint, bytes bigint, start bigint, `end` bigint, action string,
log_status string, vpc_id string, subnet_id string, instance_id string, tcp_flags int, type string,
pkt_srcaddr string, pkt_dstaddr string, region string, az_id string, sublocation_type string,
sublocation_id string, pkt_src_aws_service string, pkt_dst_aws_service string, flow_direction string, traffic_path int"""

# Field order of a CDN access record.
CDN_SCHEMA = """date string, time string, x_edge_location string, sc_bytes bigint, c_ip string, cs_method string,
cs_host string, cs_uri_stem string, sc_status int, cs_referer string, cs_user_agent string, cs_uri_query string,
x_edge_result_type string, x_edge_request_id string"""

ACCESS_LINE = (r'^(\S+) - (\S+) \[([^\]]+)\] "(\S+) (\S+)(?: ([^"]*))?" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'
               r'(?: rt=(\S+))?(?: urt=(\S+))?(?: cs=(\S+))?\s*$')


def scan_parquet(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def scan_flow_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Space-delimited flow records; ``-`` reads as null and epoch seconds as timestamps."""
    raw = spark.read.schema(FLOW_SCHEMA).option("sep", " ").option("nullValue", "-").csv(path)
    return with_flow_times(raw)


def with_flow_times(raw: DataFrame) -> DataFrame:
    seconds = lambda c: from_micros(F.col(c) * 1_000_000)
    return (raw.withColumn("start", seconds("start")).withColumn("end", seconds("end"))
            .withColumn("date", F.col("start").cast("date")))


def scan_cdn_logs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated CDN records with ``#`` comment lines."""
    return spark.read.schema(CDN_SCHEMA).option("sep", "\t").option("comment", "#").option("nullValue", "-").csv(path)


def parse_access_log(df: DataFrame, col: str = "line") -> tuple[DataFrame, DataFrame]:
    """Parsed rows of the combined or detailed format, and the lines that have neither."""
    # One regex pass per line: the groups are joined by a control character and split again.
    joined = F.regexp_replace(col, ACCESS_LINE, "\x01" + "\x01".join(f"${i}" for i in range(1, 14)))
    split = df.withColumn("_joined", joined).withColumn("_parts", F.split("_joined", "\x01"))
    # An unmatched line comes back unchanged; one that holds the separator has too many parts.
    fits = F.coalesce((F.col("_joined") != F.col(col)) & (F.size("_parts") == 14), F.lit(False))
    group = lambda i: F.get("_parts", F.lit(i))
    value = lambda i: F.when(~group(i).isin("", "-"), group(i))
    parsed = split.where(fits).withColumns({
        "client": group(1), "user": value(2),
        "ts": F.try_to_timestamp(group(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z")), "method": group(4), "path": group(5),
        "protocol": value(6), "status": group(7).cast("int"), "bytes": F.coalesce(value(8).cast("bigint"), F.lit(0)),
        "referer": value(9), "agent": group(10), "rt": value(11).try_cast("double"), "urt": value(12).try_cast("double"),
        "cache": value(13)}).drop(col, "_joined", "_parts")
    return parsed, split.where(~fits).drop("_joined", "_parts")


def parse_json_log(df: DataFrame, schema: str, col: str = "line") -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and the raw lines that are not valid for the schema."""
    typed = F.from_json(F.col(col), schema + ", _corrupt_record string", {"mode": "PERMISSIVE"})
    parsed = df.withColumn("_doc", typed)
    bad = F.coalesce(F.col("_doc._corrupt_record").isNotNull(), F.lit(True)) | F.col(col).isNull()
    good = parsed.where(~bad).select(*[c for c in df.columns if c != col], "_doc.*").drop("_corrupt_record")
    return good, parsed.where(bad).drop("_doc")


def parse_glob(df: DataFrame, col: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """``parse "user * did *"``: one column per ``*``; empty when the row does not fit."""
    regex = glob_capture(pattern)
    return df.withColumns({name: F.regexp_extract(col, regex, i + 1) for i, name in enumerate(names)})


def scan_partitioned(spark: SparkSession, path: str, predicate: Column, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Hive-style directories; a predicate on partition columns prunes whole directories."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path).where(predicate)


def projected_paths(template: str, enums: Mapping[str, Sequence[str]], days: tuple[date, date], day_format: str = "%Y/%m/%d") -> str:
    """One glob for the wanted combinations of ``${name}`` values and ``${day}``; absent folders just do not match."""
    span = (days[1] - days[0]).days
    wanted = {**enums, "day": list(dict.fromkeys((days[0] + timedelta(n)).strftime(day_format) for n in range(span + 1)))}
    return re.sub(r"\$\{(\w+)\}", lambda m: "{" + ",".join(wanted[m.group(1)]) + "}", template)


def scan_projected(spark: SparkSession, template: str, enums: Mapping[str, Sequence[str]], days: tuple[date, date],
                   schema: str = FLOW_SCHEMA, day_format: str = "%Y/%m/%d") -> DataFrame:
    """Partition projection: folders are computed from the template, no catalog and no full listing."""
    shape = re.sub(r"\\\$\\\{(\w+)\\\}", "(.+?)" , re.escape(template)) + "/[^/]+$"
    names = re.findall(r"\$\{(\w+)\}", template)
    try:
        raw = spark.read.schema(schema).option("sep", " ").option("nullValue", "-").csv(projected_paths(template, enums, days, day_format))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        raw = spark.createDataFrame([], schema)
        return raw.withColumns({n: F.lit(None).cast("string") for n in names})
    place = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    return raw.withColumns({f"part_{n}" if n in raw.columns else n: F.regexp_extract(place, shape, i + 1) for i, n in enumerate(names)})


def partitioned_table(spark: SparkSession, table: str, path: str, schema: str, by: str, fmt: str = "parquet") -> None:
    """Catalog entry for an existing directory; partitions are added separately."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING {fmt} PARTITIONED BY ({by}) LOCATION '{path}'")


def add_partition(spark: SparkSession, table: str, values: Mapping[str, str], location: str) -> None:
    spec = ", ".join(f"{k} = '{v}'" for k, v in values.items())
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION '{location}'")


def repair(spark: SparkSession, table: str) -> None:
    """Register every partition directory found on storage."""
    spark.sql(f"MSCK REPAIR TABLE {table}")


def read_stream(spark: SparkSession, where: str, schema: str | StructType | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """A keyed, ordered source: a Kafka topic (``fmt='kafka'``, connector needed) or files."""
    reader = spark.readStream.format(fmt)
    for name, value in options.items():
        reader = reader.option(name, value)
    if fmt == "kafka":
        return reader.option("subscribe", where).load()
    return reader.schema(schema).load(where)


def flatten(df: DataFrame, path: str, fields: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """``flatten(df, "a[*].b[*]", {"id": "x"})``: one row per innermost element."""
    current, holder = df, None
    for number, step in enumerate(path.replace("[*]", "").split(".")):
        source = F.col(step) if holder is None else F.col(f"{holder}.{step}")
        holder = f"_item{number}"
        current = current.withColumn(holder, F.explode(source))
    return current.select(*keep, *[F.col(f"{holder}.{source}").alias(out) for out, source in fields.items()])


def decode(df: DataFrame, col: str, fmt: str, schema: str, descriptor: str | None = None) -> DataFrame:
    """Avro (JSON schema) or Protobuf (message name and descriptor file) bytes to a struct.

    Needs the matching external connector on the session's class path.
    """
    if fmt == "avro":
        from pyspark.sql.avro.functions import from_avro
        return df.withColumn(col, from_avro(F.col(col), schema))
    if fmt == "protobuf":
        from pyspark.sql.protobuf.functions import from_protobuf
        return df.withColumn(col, from_protobuf(F.col(col), schema, descriptor))
    raise ValueError(f"unknown format {fmt}")


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files with their SHA-256, for integrity checks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"), "length")


def enum_product(enums: Mapping[str, Sequence[str]]) -> list[dict[str, str]]:
    """All combinations of enumerated partition values."""
    return [dict(zip(enums, combo)) for combo in itertools.product(*enums.values())]
