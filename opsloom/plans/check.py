"""Compare registered queries with their SQL on DuckDB: ``python -m opsloom.plans.check DIR [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from opsloom.plans.catalogue import REGISTRY
from opsloom.plans.registry import TABLES
from opsloom.session import local_session


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(v is None, str(v)) for v in r])


# Families of types a strict comparison would tell apart.
FAMILIES = {"bigint": "long", "int": "int", "double": "double", "string": "string", "boolean": "bool", "date": "date",
            "timestamp_ntz": "ts", "BIGINT": "long", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
            "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "ts"}


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, path: str) -> str | None:
    """None when both agree, else what differs."""
    q = REGISTRY[name]
    df = q(spark, path)
    ours = rows(df.columns, df.collect())
    if not ours:
        return "no rows"
    if q.sql is None:
        return None
    cur = con.execute(q.sql)
    theirs = rows([d[0] for d in cur.description], cur.fetchall())
    if sorted(df.columns) != sorted(d[0] for d in cur.description):
        return f"columns {sorted(df.columns)} != {sorted(d[0] for d in cur.description)}"
    spark_types = {c: FAMILIES.get(k, k) for c, k in df.dtypes}
    sql_types = {d[0]: FAMILIES.get(str(d[1]), str(d[1])) for d in cur.description}
    if spark_types != sql_types:
        return f"types {set(spark_types.items()) ^ set(sql_types.items())}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{sorted(df.columns)}: {a} != {b}"
    return None


def main(path: str, names: list[str]) -> int:
    spark = local_session(8)
    con = connect(path)
    wanted = [n for n in REGISTRY if not names or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) or
              REGISTRY[n].build.__module__.endswith("." + w) for w in names)]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, name, path)
        except Exception as error:  # report and go on with the next query
            lines = [line for line in str(error).strip().splitlines() if line][:3]
            problem = f"{type(error).__name__}: {' | '.join(lines)[:600]}"
            if len(wanted) == 1:
                traceback.print_exc()
        bad += problem is not None
        sql_state = "" if REGISTRY[name].sql else " (no sql)"
        if problem or time.time() - start > 8 or len(wanted) < 4:
            print(f"{'FAIL' if problem else 'ok'} {name}{sql_state} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
