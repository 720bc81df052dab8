"""Quality classifier: naive Bayes log-count ratios as the scale of n-gram indicators, under a linear hinge-loss model.

N-grams are taken from two readings of a text: its lower-cased words (one and two), and the words' shapes (one to three).
A shape has each letter as upper or lower case and each digit as a digit, keeps other characters, shortens runs to two, and
says whether the word repeats the one before. An n-gram is the number of a hash cell; a document has a cell or not.

Training reads the labelled documents once. Cells are counted per class in Spark over all of them, but for a fifth of the
ids that only calibrates. The cells of strongest association become the features; the model is fitted by dual coordinate
descent on at most ``SAMPLE`` of the counted rows, and a logistic curve from margin to probability on at most ``SAMPLE`` of
the calibrating ones. Every document is scored, over its whole text, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.text import batch_bytes, mix, slices, spans, word_hashes
from opsloom.session import work_path

#: Labelled rows used for fitting, and for calibration, at most each.
SAMPLE = 20_000
CELLS = 1 << 18
#: Features, the least documents a feature's cell needs, and the least G-squared of its association.
FEATURES, LEAST_DOCS, LEAST_SCORE = 4_096, 5, 10.0
SMOOTH = 1.0
#: Bound of the dual variables, weight between the plain and the mean model, and the most passes.
COST, BLEND, PASSES = 1.0, 0.25, 60
CALIBRATION_SHARE = 5
#: Words at a time whose n-grams are held in memory.
STEP = 1 << 20

#: Bits per key, and most words of 64 bits, of the filter that keeps texts without a label from the shuffle.
FILTER_BITS, FILTER_WORDS = 16, 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = _LOWER.copy()
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58] = ord("X"), ord("x"), ord("9")
_SHAPE[128:] = ord("x")
#: Hashes of n-grams of several readings must differ.
_SALTS = np.random.Generator(np.random.PCG64(31)).integers(1, 2**63, size=8, dtype=np.uint64) | np.uint64(1)


def _shapes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the shapes of all words, each followed by a space, and the documents' bounds in them."""
    shape = _SHAPE[data]
    starts, ends, first = spans(data, bounds)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1]) > 0
    third = np.zeros(len(data), dtype=bool)
    third[2:] = (shape[2:] == shape[1:-1]) & (shape[1:-1] == shape[:-2]) & inside[1:-1] & inside[:-2]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    # A run doesn't go on over the beginning of a word.
    third[1:] &= ~edge[1:-1]
    third[2:] &= ~edge[1:-2]
    keep = inside & ~third
    last = np.zeros(len(data), dtype=bool)
    last[ends - 1] = True
    lengths = keep.astype(np.int64) + last
    out = np.full(int(lengths.sum()), 32, dtype=np.uint8)
    at = np.cumsum(lengths) - lengths
    out[at[keep]] = shape[keep]
    total = np.concatenate(([0], np.cumsum(lengths)))
    return out, total[bounds]


def cells(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    """Ascending hash cells of each text's n-grams."""
    data, bounds = batch_bytes(batch.column(batch.schema.get_field_index(column)))
    words, first = word_hashes(_LOWER[data], bounds)
    shapes, _ = word_hashes(*_shapes(data, bounds))
    if len(words):
        same = np.zeros(len(words), dtype=bool)
        same[1:] = words[1:] == words[:-1]
        same[first[:-1][first[:-1] < len(words)]] = False
        shapes = shapes ^ np.where(same, _SALTS[7], np.uint64(0))
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        found = np.zeros(CELLS, dtype=bool) if high - low > STEP else None
        parts = []
        for at in range(low, high, STEP):
            # The steps overlap by two words, so that no n-gram is lost.
            w, s = words[at:min(high, at + STEP + 2)], shapes[at:min(high, at + STEP + 2)]
            grams = [w * _SALTS[0], w[:-1] * _SALTS[1] + w[1:] * _SALTS[2], s * _SALTS[3], s[:-1] * _SALTS[4] + s[1:] * _SALTS[5],
                     s[:-2] * _SALTS[6] + s[1:-1] * _SALTS[4] + s[2:] * _SALTS[5]]
            hits = (mix(np.concatenate(grams)) >> np.uint64(46)).astype(np.int32)
            if found is None:
                parts.append(hits)
            else:
                found[hits] = True
        out.append(np.flatnonzero(found).astype(np.int32) if found is not None
                   else np.unique(parts[0]) if parts else np.zeros(0, dtype=np.int32))
    return out


@dataclass(frozen=True)
class Model:
    """Weight of every cell (zero where it is no feature), the least norm's share, intercept, and the curve to probability."""

    scale: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        scale = self.scale[found]
        norm = math.sqrt(float(scale @ scale))
        return (float(self.weights[found] @ scale) / norm if norm > 0 else 0.0) + self.intercept

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -35, 35)))


# --- fitting -------------------------------------------------------------------------------------

def log_ratios(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Scale of each cell from its documents per class ``counts`` (cell, class) and the classes' ``totals``: zero if no feature.

    The ratio compares the smoothed shares of documents of class 1 and 0 that hold the cell.
    """
    docs = counts.sum(axis=1)
    n = totals.sum()
    if n == 0 or totals.min() == 0:
        return np.zeros(len(counts))
    expected = docs[:, None] * totals[None, :] / n
    absent, expected_absent = totals[None, :] - counts, totals[None, :] - expected
    with np.errstate(divide="ignore", invalid="ignore"):
        score = 2 * (np.where(counts > 0, counts * np.log(counts / expected), 0)
                     + np.where(absent > 0, absent * np.log(absent / expected_absent), 0)).sum(axis=1)
    shares = (counts + SMOOTH) / (totals + 2 * SMOOTH)
    ratio = np.log(shares[:, 1] / shares[:, 0])
    good = np.flatnonzero((docs >= LEAST_DOCS) & (score >= LEAST_SCORE))
    good = good[np.argsort(-score[good], kind="stable")][:FEATURES]
    out = np.zeros(len(counts))
    out[good] = ratio[good]
    return out


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: float = COST,
                            passes: int = PASSES, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and intercept of the squared-norm, hinge-loss model; the classes' costs balance their sizes.

    Each step solves the dual for one row exactly: its variable moves to the minimum inside [0, bound]. The intercept is the
    weight of a constant feature. Passes end when no projected gradient exceeds a hundredth.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    bound = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    squares = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(y)).tolist():
            idx, val = rows[i], values[i]
            gradient = y[i] * (float(w[idx] @ val) + b) - 1.0
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= bound[i] else gradient
            if projected == 0.0:
                continue
            worst = max(worst, abs(projected))
            new = min(max(alpha[i] - gradient / squares[i], 0.0), bound[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[idx] += step * val
            b += step
        if worst < 0.01:
            break
    return w, b


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to labels, by Newton steps; targets are smoothed."""
    positive, negative = float((labels > 0).sum()), float((labels <= 0).sum())
    if positive == 0 or negative == 0:
        return 1.0, math.log((positive + 0.5) / (negative + 0.5))
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.column_stack((margins, np.ones(len(margins))))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - target) + 1e-3 * np.array([w[0] - 1.0, 0.0])
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        size = float(np.abs(step).max())
        w = w - step * min(1.0, 5.0 / size if size > 0 else 1.0)
        if size < 1e-6:
            break
    # A curve that falls with the margin would turn the model round.
    return max(float(w[0]), 1e-3), float(w[1])


def fit(scale: np.ndarray, sample: tuple[list[np.ndarray], np.ndarray], held: tuple[list[np.ndarray], np.ndarray]) -> Model:
    """The model from the cells' ratios, fitting rows and calibrating rows, each as (cells, labels)."""
    features = np.flatnonzero(scale)
    place = np.zeros(len(scale), dtype=np.int64)
    place[features] = np.arange(len(features))
    rows, labels = sample
    values = []
    for r in rows:
        v = scale[r]
        norm = math.sqrt(float(v @ v))
        values.append(v / norm if norm > 0 else v)
    w, b = dual_coordinate_descent([place[r] for r in rows], values, labels, len(features))
    # Between the fitted weights and their mean magnitude, which is plain naive Bayes.
    mean = float(np.abs(w).mean()) if len(w) else 0.0
    weights = np.zeros(len(scale))
    weights[features] = (1 - BLEND) * w + BLEND * mean * np.sign(w)
    plain = Model(scale, weights, b, 1.0, 0.0)
    slope, offset = calibrate(np.array([plain.margin(r) for r in held[0]]), held[1])
    return Model(scale.astype(np.float32), weights.astype(np.float32), b, slope, offset)


# --- Spark ---------------------------------------------------------------------------------------

def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            packed = pa.array([c.tobytes() for c in cells(part, "text")], pa.binary())
            yield pa.record_batch([part.column(0), part.column(1), part.column(2), packed], names=["key", "label", "spot", "cells"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, CELLS), dtype=np.int64)
    for batch in batches:
        for label, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[label, np.frombuffer(packed.as_buffer() or b"", dtype=np.int32)] += 1
    seen = np.flatnonzero(sums.any(axis=0))
    yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(sums[0, seen]), pa.array(sums[1, seen])], names=["cell", "low", "high"])


def _only(features: np.ndarray):
    """A function for ``mapInArrow`` that leaves no cells but the features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (np.frombuffer(c.as_buffer() or b"", dtype=np.int32) for c in batch.column(2))
            packed = pa.array([c[np.isin(c, features)].tobytes() for c in found], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), packed], names=batch.schema.names)
    return run


def _sample(rows: DataFrame, total: int, most: int, features: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """About ``most`` rows of the smallest id hashes, and never more, with their features; a repeated id counts once."""
    span = 1 << 62
    share = min(1.0, 0.95 * most / total) if total else 0.0
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(77), "key"), 2)
    picked = rows.where(spot < int(span * share)) if share < 1 else rows
    kind = rows.schema["key"].dataType.simpleString()
    picked = picked.select("key", "label", "cells").mapInArrow(_only(features), f"key {kind}, label int, cells binary")
    table = picked.groupBy("key").agg(F.min(F.struct("label", "cells")).alias("r")).orderBy("key").limit(most).select("r.*").toArrow()
    found = [np.frombuffer(c.as_buffer() or b"", dtype=np.int32) for c in table.column("cells")]
    return found, np.array(table.column("label").to_pylist(), dtype=np.int64)


def _perhaps_in(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in ``known``: one bit per key in at most ``FILTER_WORDS`` words of 64 bits."""
    if rows.schema["key"].dataType != known.schema["key"].dataType:  # equal keys of two types have two hashes
        return rows
    words = min(FILTER_WORDS, 1 << max(0, (known.count() * FILTER_BITS // 64).bit_length()))
    spot = lambda d: F.pmod(F.xxhash64(F.lit(91), d["key"]), F.lit(words * 64))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot(known), F.lit(64)).cast("int"))
    held = known.groupBy(F.shiftright(spot(known), 6).alias("id")).agg(F.bit_or(one).alias("bits"))
    every = known.sparkSession.range(words).join(held, "id", "left")
    field = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))["bits"].alias("bits")).scalar()
    word = F.get(field, F.shiftright(spot(rows), 6).cast("int"))
    return rows.where(F.getbit(word, F.pmod(spot(rows), F.lit(64)).cast("int")) == 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """A model of ``label`` (1 or 0) from the labelled rows of ``docs``.

    Rows of ``labels`` with a null key or label are left out; a key with several labels has the smallest. Repeated documents
    count as often as they occur, but enter the fitted sample once per key. With one class or no labelled document the model
    gives its (smoothed) share. Null texts count as empty. The driver gets the cell counts (at most ``CELLS``) and ``sample``
    rows, of at most ``FEATURES`` cells, for each of fit and calibration.
    """
    spark = docs.sparkSession
    known = (labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
             .groupBy("key").agg(F.min("label").alias("label")))
    spot = F.pmod(F.xxhash64(F.lit(55), "key"), F.lit(CALIBRATION_SHARE)).cast("int")
    # Few texts without a label reach the shuffle; the join is the same at every size.
    texts = _perhaps_in(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), known).join(known.hint("merge"), "key")
    kind = texts.schema["key"].dataType.simpleString()
    path = work_path(spark, "quality-rows")
    texts.select("key", "label", spot.alias("spot"), "text").mapInArrow(
        _rows, f"key {kind}, label int, spot int, cells binary").write.partitionBy("spot").parquet(path)
    rows = spark.read.schema(f"key {kind}, label int, cells binary, spot int").parquet(path)
    counted = rows.where("spot > 0")
    table = counted.select("label", "cells").mapInArrow(_counts, "cell int, low long, high long").groupBy("cell").agg(
        F.sum("low").alias("low"), F.sum("high").alias("high")).toArrow()
    counts = np.zeros((CELLS, 2))
    cell = table.column("cell").to_numpy()
    counts[cell, 0], counts[cell, 1] = table.column("low").to_numpy(), table.column("high").to_numpy()
    sizes = {(r["held"], r["label"]): (r["n"], r["ids"]) for r in rows.groupBy((F.col("spot") == 0).alias("held"), "label").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("key").alias("ids")).collect()}
    totals = np.array([sizes.get((False, c), (0, 0))[0] for c in (0, 1)], dtype=float)
    ids = [sum(sizes.get((held, c), (0, 0))[1] for c in (0, 1)) for held in (False, True)]
    scale = log_ratios(counts, totals)
    features = np.flatnonzero(scale).astype(np.int32)
    return fit(scale, _sample(counted, ids[0], sample, features), _sample(rows.where("spot = 0"), ids[1], sample, features))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score`` (0 to 1) and ``predicted`` of every row; an empty or null text has the score of the intercept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                p = model.probability(np.array([model.margin(c) for c in cells(part, "_text")], dtype=float))
                yield pa.record_batch([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    rows = docs.select(key, F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, score double, predicted int")
