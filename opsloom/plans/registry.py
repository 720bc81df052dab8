"""Registry of the named queries: what to run on Spark and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


class Tables:
    """Lazy access to the parquet tables of one directory."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, path: str) -> DataFrame:
        return doubles(self.build(Tables(spark, path)))


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None) -> Callable:

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, ids, build, sql)
        return build

    return register


def doubles(df: DataFrame) -> DataFrame:
    """Decimals stay exact inside a plan and become doubles only in its result."""
    wide = {f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema.fields
            if f.dataType.typeName() == "decimal"}
    return df.withColumns(wide) if wide else df
