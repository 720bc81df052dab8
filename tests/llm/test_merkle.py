import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from opsloom.llm import merkle
from opsloom.llm.queries import SQL


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """All levels of the tree over ``nodes``."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h("".join(low[i:i + 2])) for i in range(0, len(low), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i - i % 2:i - i % 2 + 2]
        out.append((run[0], "") if i % 2 else ("", run[1] if len(run) > 1 else ""))
        i //= 2
    return out


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for number, g in enumerate(order):
        for i, (known, doc_id, digest) in enumerate(sorted(groups[g])):
            path = siblings(trees[g], i) + siblings(top, number)
            out.append((doc_id if known else None, digest, trees[g][-1][0], top[-1][0], path))
    return sorted(out, key=str)


def found(spark, rows, extra=None):
    from tests.llm.conftest import SCHEMA
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, value in (extra or {}).items():
        docs = docs.withColumn(name, value)
    df = merkle.manifest(docs)
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in df.collect()], key=str)


@pytest.mark.parametrize("levels", [3, 10])
def test_paths_equal_plain_trees(spark, shared, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    langs = [None, "", "-", "de", "en", "é", "z"]
    rows = [(rng.randrange(60) if rng.random() > 0.05 else None, rng.choice(["", None, "a", "Straße 1\n", "x" * 50]),
             rng.choice(langs if rng.random() < 0.4 else ["en"]), rng.choice(["s", None]), rng.choice([None, 0, 7])) for _ in range(150)]
    rows += [(1, "only", "xx", "s", 4)]
    rows += [(5, "same", "en", "s", 4)] * 40  # one key and row for a large part
    clash = {"group": F.lit(1), "pos": F.lit("x"), "digest": F.lit(None), "key": F.lit(3), "leaf": F.lit(2), "path": F.lit(0)}
    assert found(spark, rows, clash) == brute(rows)


def test_small_tables_and_long_texts(spark, shared):
    assert found(spark, []) == []
    one = [(7, "ä" * 3_000_000, "en", None, None)]
    assert found(spark, one) == brute(one) == [(7, leaf(7, None, "en", None, one[0][1]),) + (leaf(7, None, "en", None, one[0][1]),) * 2 + ([],)]


def test_folding_finds_tampering(spark, shared):
    from tests.llm.conftest import SCHEMA
    rows = [(i, f"text {i}", "en" if i % 3 else None, "s", None if i % 5 == 0 else i) for i in range(70)]
    docs = spark.createDataFrame(rows, SCHEMA)
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")]
    df = merkle.manifest(docs, carry={"altered": merkle.digest(fields)})
    good = df.withColumn("ok", merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"))
    assert {r.ok for r in good.collect()} == {True}
    bad = df.withColumn("ok", merkle.fold(F.col("altered"), F.col("path")) == F.col("root"))
    assert {r.doc_id for r in bad.collect() if r.ok} == {i for i in range(70) if i % 5 == 0}


def test_one_task_holds_no_whole_group(spark, shared, monkeypatch):
    """The rows of a group are dealt by range; joins see one row per block."""
    from tests.llm.conftest import SCHEMA
    monkeypatch.setattr(merkle, "LEVELS", 4)
    docs = spark.createDataFrame([(i % 7, "t", "en", "s", 1) for i in range(2000)], SCHEMA).repartition(4)
    leaves = docs.select(F.lit("=en").alias("group"), F.col("doc_id").alias("key"), F.col("text").alias("digest"),
                         F.monotonically_increasing_id().alias("twin"))
    placed = merkle._place(leaves, ["key", "digest", "twin"])
    assert sorted(r.pos for r in placed.collect()) == list(range(2000))
    sizes = placed.groupBy(F.shiftright("pos", 4).alias("b")).count().collect()
    assert {r["count"] for r in sizes} == {16}


def test_sql_and_query_agree(spark, shared, data):
    import duckdb

    from opsloom.llm.queries import QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = QUERIES["op11_merkle_manifest"](spark, data)
    cur = con.execute(SQL["op11_merkle_manifest"])
    names = [d[0] for d in cur.description]
    theirs = sorted(tuple(dict(zip(names, r))[c] for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == theirs
    changed = {r.doc_id for r in df.collect() if not r.verified}
    assert changed and all(zlib.crc32(str(i).encode()) % 7 == 0 for i in changed)
