import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opsloom.llm import nbsvm
from opsloom.llm.queries import QUERIES
from opsloom.llm.text import word_hashes


def found(texts, monkeypatch=None):
    batch = pa.record_batch([pa.array([None if t is None else t.encode() for t in texts], pa.binary())], names=["t"])
    return nbsvm.cells(batch, "t")


def plain_shape(word):
    out = ""
    for byte in word.encode():
        c = "X" if 65 <= byte <= 90 else "x" if 97 <= byte <= 122 or byte >= 128 else "9" if 48 <= byte <= 57 else chr(byte)
        if out[-2:] != c + c:
            out += c
    return out


def test_shapes():
    texts = ["Abc DEF12345 !!!! x", "", "Straße  aaab", "a a a"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    out, ends = nbsvm._shapes(data, bounds)
    shown = bytes(out).decode()
    got = [shown[a:b] for a, b in zip(ends, ends[1:])]
    assert got == ["".join(plain_shape(w) + " " for w in t.split()) for t in texts]


def test_cells_are_those_of_each_text_alone(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", "  ", "one", "One one ONE!", *(" ".join(rng.choice(["a", "Bb", "c1", "d!!", "e"]) for _ in range(rng.randrange(1, 60))) for _ in range(30))]
    together = found(texts)
    for text, cells in zip(texts, together):
        assert cells.tolist() == found([text])[0].tolist() == sorted(set(cells.tolist()))
    monkeypatch.setattr(nbsvm, "STEP", 7)
    assert [c.tolist() for c in found(texts)] == [c.tolist() for c in together]
    # Words, pairs, and shapes of up to three words, by hash.
    h, _ = word_hashes(np.frombuffer(b"ab cd", dtype=np.uint8), np.array([0, 5]))
    from opsloom.llm.text import mix
    gram = int((mix(h[:1] * nbsvm._SALTS[1] + h[1:] * nbsvm._SALTS[2]) >> np.uint64(46))[0])
    assert gram in found(["Ab CD"])[0] and gram not in found(["cd ab"])[0] and len(found(["ab cd"])[0]) == 5


def test_descent_reaches_the_least_objective():
    """No small change of the weights lowers the primal objective, and the dual value meets it."""
    rng = np.random.default_rng(3)
    x = (rng.random((80, 12)) < 0.4).astype(float)
    labels = (x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(0, 0.6, 80) > 0.5).astype(int)
    rows = [np.flatnonzero(r) for r in x]
    w, b = nbsvm.dual_coordinate_descent(rows, [np.ones(len(r)) for r in rows], labels, 12, passes=3000)
    y = np.where(labels > 0, 1.0, -1.0)
    bound = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))

    def objective(v):
        return 0.5 * v @ v + (bound * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))).sum()

    best = objective(np.append(w, b))
    for _ in range(4000):
        assert objective(np.append(w, b) + rng.normal(0, rng.choice([0.3, 0.03]), 13)) > best - 0.02 * best


def test_ratios_and_curve():
    counts = np.array([[50, 2], [3, 60], [40, 41], [1, 0]], dtype=float)
    scale = nbsvm.log_ratios(counts, np.array([100.0, 100.0]))
    assert scale[0] < 0 < scale[1] and scale[2] == scale[3] == 0
    assert scale[1] == pytest.approx(np.log((61 / 102) / (4 / 102)))
    assert not nbsvm.log_ratios(counts, np.array([0.0, 5.0])).any()
    slope, offset = nbsvm.calibrate(np.array([-2.0, -1.5, 1.0, 2.0]), np.array([0, 0, 1, 1]))
    assert slope > 0 and abs(offset) < slope


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_held_out_accuracy_and_odd_rows(spark, shared):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]

    def make(good):
        ws = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        if not good:
            kind = rng.randrange(3)
            ws = [w.upper() + "!!" for w in ws] if kind == 0 else [w + "***" for w in ws] if kind == 1 else [w for w in ws for _ in range(4)]
        return " ".join(ws)

    truth = {i: int(rng.random() < 0.75) for i in range(600)}
    rows = [(i, make(g)) for i, g in truth.items()] + [(5, make(truth[5]))] * 300 + [(1000, None), (1001, ""), (None, "x y"), (1002, "long! " * 600_000)]
    labels = [(i, g) for i, g in truth.items() if i < 400] + [(7, 1), (7, 0), (None, 1), (1000, None)]
    docs = _docs(spark, rows).withColumn("score", F.lit("clash")).withColumn("label", F.lit(3)).withColumn("_text", F.lit(1)).withColumn("cells", F.lit(0))
    known = spark.createDataFrame(labels, "doc_id bigint, quality int").withColumn("label", F.lit(9)).withColumn("text", F.lit("t"))
    model = nbsvm.train(docs, known)
    out = nbsvm.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    new = [r for r in out if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert sum(r.predicted == truth[r.doc_id] for r in new) / len(new) > 0.95
    again = nbsvm.train(docs.repartition(5), known)
    assert np.array_equal(again.weights, model.weights) and again.slope == model.slope
    few = nbsvm.train(docs, known, sample=100)
    assert sum(p.predicted == truth[p.doc_id] for p in nbsvm.score(docs, few).collect() if p.doc_id in truth) > 700


def test_no_labels_one_class_no_rows(spark, shared):
    docs = _docs(spark, [(i, f"text {i}") for i in range(20)])
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {round(r.score, 6) for r in nbsvm.score(docs, nbsvm.train(docs, empty)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    assert all(r.predicted == 1 for r in nbsvm.score(docs, nbsvm.train(docs, ones)).collect())
    none = _docs(spark, [])
    assert nbsvm.score(none, nbsvm.train(none, ones)).count() == 0


def test_query(spark, shared, parity_data):
    rows = QUERIES["op13_quality_classifier"](spark, parity_data)
    labels = spark.read.parquet(f"{parity_data}/labels.parquet")
    held = rows.join(labels, "doc_id").where("held_out").select((F.col("predicted") == F.col("quality")).cast("int").alias("hit"))
    assert rows.count() == spark.read.parquet(f"{parity_data}/documents.parquet").count()
    assert held.agg(F.avg("hit")).first()[0] > 0.9


def test_few_texts_without_a_label_are_shuffled(spark, monkeypatch):
    """The filter keeps every labelled row, repeated or not, and drops most others; a full one keeps all."""
    docs = spark.range(20_000).union(spark.range(50)).selectExpr("id AS key", "'t' AS text").union(spark.createDataFrame([(None, "t")], "key long, text string"))
    known = spark.range(0, 20_000, 20).selectExpr("id AS key", "1 AS label")
    kept = nbsvm._perhaps_in(docs, known)
    assert kept.join(known, "key").count() == 1_003
    assert kept.count() < 1_003 + 20_000 * 0.13
    assert nbsvm._perhaps_in(docs, known.where("false")).count() == 0
    assert nbsvm._perhaps_in(docs, known.selectExpr("int(key) AS key", "label")).join(known, "key").count() == 1_003
    monkeypatch.setattr(nbsvm, "FILTER_WORDS", 1)
    assert nbsvm._perhaps_in(docs, known).join(known, "key").count() == 1_003
