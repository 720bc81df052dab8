import duckdb
import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """The shared folder of the tests: set only where the session has none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark.conf.get("spark.checkpoint.dir")


@pytest.fixture
def documents(spark, shared):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture
def sql_rows():
    """Rows of DuckDB SQL over given (doc_id, text) documents, as dicts by doc_id."""

    def run(sql, rows):
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[1]) for r in rows])
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        return sorted(({**dict(zip(names, r))} for r in cur.fetchall()), key=str)

    return run
