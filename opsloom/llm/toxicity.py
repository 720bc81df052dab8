"""Toxicity by a chain of linear classifiers.

The categories of a label table are predicted one after another; each model also gets the log-odds of the categories before
it. In training these come from models that did not see the row (out-of-fold), so a later model learns how far an earlier
prediction can be trusted; in scoring they come from the models fitted on the whole sample.

Training takes at most ``SAMPLE`` labelled rows, those of the smallest id hashes. Terms are counted and chosen in Spark; the
sample's feature rows, of fixed width, are fitted on the driver. Every document is scored, over its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.session import cut_lineage

#: Labelled rows used for fitting, at most.
SAMPLE = 20_000
FOLDS = 5
#: Terms per category, the documents a term needs, and the least G-squared of its association.
TERMS, LEAST_DOCS, LEAST_SCORE = 96, 4, 16.0
RIDGE = 1.0
ROUNDS = 12

#: Beginnings of longer words are terms of their own, written with a hyphen: one stem has many endings.
PREFIXES = (4, 5)
#: Words whose terms a worker remembers.
CACHE = 300_000

_TERM = re.compile(r"[^\W\d_]+")
MEASURES = ("log_words", "mean_length", "upper", "symbols", "marks", "distinct")


_UPPER = {c: None for c in range(0x250) if chr(c).isupper()}


class Words(dict):
    """Word to the columns of its terms; what was asked before is remembered, up to a bound."""

    def __init__(self, index: dict[str, int]) -> None:
        super().__init__()
        self.index = index

    def __reduce__(self):
        return Words, (self.index,)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        names = [word, *[word[:n] + "-" for n in PREFIXES if len(word) > n]]
        found = self[word] = tuple(self.index[t] for t in names if t in self.index)
        return found


@dataclass(frozen=True)
class Chain:
    """The fitted chain: shared terms, and for each category its weights, intercept and decision threshold."""

    categories: tuple[str, ...]
    terms: tuple[str, ...]
    center: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    thresholds: tuple[float, ...]
    index: dict[str, int] = field(default_factory=dict)
    known: Words = field(default_factory=lambda: Words({}), compare=False)

    def features(self, texts: Sequence[str | None]) -> np.ndarray:
        return (raw_features(texts, self.known) - self.center) / self.scale

    def predict(self, features: np.ndarray) -> list[np.ndarray]:
        """Probabilities, category by category."""
        out, x = [], features
        for w in self.weights:
            odds = x @ w[1:] + w[0]
            out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            x = np.column_stack((x, np.clip(odds, -8, 8)))
        return out


def raw_features(texts: Sequence[str | None], known: Words) -> np.ndarray:
    """Counts of the terms (log) and measures of the form of each text; a null text counts as empty."""
    terms = len(known.index)
    out = np.zeros((len(texts), terms + len(MEASURES)), dtype=np.float32)
    for row, text in enumerate(texts):
        text = text or ""
        found = _TERM.findall(text.lower())
        for column, n in Counter(c for hit in map(known.__getitem__, found) if hit for c in hit).items():
            out[row, column] = math.log1p(n)
        size, words = max(1, len(text)), max(1, len(found))
        upper = len(text) - len(text.translate(_UPPER))
        out[row, terms:] = (math.log1p(len(found)), sum(map(len, found)) / words, upper / size,
                            sum(map(text.count, "#*$%&|<>")) / size, sum(map(text.count, "!?")) / size, len(set(found)) / words)
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic model (intercept first), by Newton steps with a ridge; one class alone gives its prior."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1] + 1)
    w[0] = math.log(prior / (1 - prior))
    if len(y) == 0 or y.min() == y.max():
        return w
    x = np.column_stack((np.ones(len(x)), x)).astype(np.float64)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        bend = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * bend[:, None]).T @ x + np.diag(penalty), gradient)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold probabilities, halfway to the next lower one."""
    if len(y) == 0 or y.max() == 0:
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)  # equal probabilities are cut together
    best = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float(max((p[order][best] + below) / 2, 1e-6))


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: Sequence[str], terms: Sequence[str]) -> Chain:
    center = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(axis=0) if len(x) else np.ones(x.shape[1])
    scale = np.where(scale > 1e-9, scale, 1.0)
    inputs = (x - center) / scale
    weights, thresholds = [], []
    for k in range(len(categories)):
        y = labels[:, k].astype(np.float64)
        held = np.zeros(len(y))
        for fold in range(FOLDS):
            out = folds == fold
            w = fit_linear(inputs[~out], y[~out])
            held[out] = inputs[out] @ w[1:] + w[0]
        weights.append(fit_linear(inputs, y))
        thresholds.append(_best_threshold(1 / (1 + np.exp(-np.clip(held, -30, 30))), y))
        inputs = np.column_stack((inputs, np.clip(held, -8, 8)))
    return Chain(tuple(categories), tuple(terms), center, scale, tuple(weights), tuple(thresholds), index := {t: i for i, t in enumerate(terms)}, Words(index))


def _terms(text: str) -> Column:
    """Distinct words of a text, and the beginnings of the longer ones."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1)))

    def starts(n: int) -> Column:
        longer = F.filter(found, lambda w: F.char_length(w) > n)
        return F.transform(longer, lambda w: F.concat(F.substring(w, 1, n), F.lit("-")))

    return F.array_distinct(F.concat(found, *[starts(n) for n in PREFIXES]))


def choose_terms(sample: DataFrame, text: str, categories: Sequence[str], terms: int = TERMS) -> list[str]:
    """The terms whose presence goes with a category beyond chance, by G-squared; at most ``terms`` per category."""
    positives = [F.sum(c).cast("long").alias(c) for c in categories]
    total = sample.agg(F.count(F.lit(1)).alias("n"), *positives).first()
    if not total["n"]:
        return []
    counted = sample.select(F.explode(_terms(text)).alias("term"), *categories).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), *positives).where(F.col("n") >= LEAST_DOCS)
    found: set[str] = set()
    for c in categories:
        n, yes = float(total["n"]), float(total[c] or 0)
        if not 0 < yes < n:
            continue
        a, b = F.col(c).cast("double"), (F.col("n") - F.col(c)).cast("double")

        def part(seen: Column, row: Column, column: float) -> Column:
            return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

        absent = F.lit(n) - F.col("n")
        score = 2 * (part(a, F.col("n"), yes) + part(b, F.col("n"), n - yes) + part(yes - a, absent, yes) + part(n - yes - b, absent, n - yes))
        best = counted.withColumn("score", score).where(F.col("score") >= LEAST_SCORE).orderBy(F.col("score").desc(), "term").limit(terms)
        found.update(r["term"] for r in best.select("term").collect())
    return sorted(found)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> Chain:
    """Fit the chain in the order of ``categories`` (name to 0/1 column over ``labels``), on at most ``sample`` labelled rows.

    Rows with a null key or a null label are not used; without any, every probability is a prior of one half and nothing
    is flagged.
    """
    names = list(categories)
    marks = labels.select(F.col(key), *[c.cast("int").alias(n) for n, c in categories.items()]).dropna()
    chosen = marks.orderBy(F.xxhash64(key), key, *names).limit(sample)
    rows = cut_lineage(chosen.join(docs.select(F.col(key), F.col(text).alias("_text")), key))
    terms = choose_terms(rows, "_text", names)
    known = Words({t: i for i, t in enumerate(terms)})
    width = len(terms) + len(MEASURES)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = raw_features(batch.column(batch.schema.get_field_index("_text")).to_pylist(), known)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("fold", *names)]
            yield pa.record_batch([*kept, pa.array([r.tobytes() for r in x], pa.binary())], names=["fold", *names, "x"])

    folded = rows.select(F.pmod(F.xxhash64(F.lit(1), key), F.lit(FOLDS)).cast("int").alias("fold"), *names, "_text")
    # At most ``sample`` rows of fixed width.
    data = folded.mapInArrow(featurise, f"fold int, {', '.join(f'{n} int' for n in names)}, x binary").toArrow()
    x = np.frombuffer(b"".join(data.column("x").to_pylist()), dtype=np.float32).reshape(-1, width).astype(np.float64)
    y = np.stack([data.column(n).to_numpy() for n in names], axis=1) if len(x) else np.zeros((0, len(names)))
    # A fixed order, so that reruns fit the same model.
    order = np.lexsort((*x.T[::-1], *y.T, data.column("fold").to_numpy())) if len(x) else np.zeros(0, np.int64)
    return fit_chain(x[order], y[order], data.column("fold").to_numpy()[order], names, terms)


def score(docs: DataFrame, chain: Chain, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``p_<category>`` and ``is_<category>`` for each category of the chain.

    Every row is scored by itself; null and empty texts have no terms. Kept columns must not carry an output's name.
    """
    keep = list(keep)
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            found = [chain.predict(chain.features([t.as_py() for t in texts.slice(at, 512)])) for at in range(0, batch.num_rows, 512)]
            columns, names = [], []
            for k, name in enumerate(chain.categories):
                p = np.concatenate([f[k] for f in found]) if found else np.zeros(0)
                columns += [pa.array(p, pa.float64()), pa.array(p >= chain.thresholds[k], pa.bool_())]
                names += [f"p_{name}", f"is_{name}"]
            yield pa.record_batch([*[batch.column(batch.schema.get_field_index(n)) for n in keep], *columns], names=[*keep, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields]
    fields += [f"p_{c} double, is_{c} boolean" for c in chain.categories]
    return rows.mapInArrow(run, ", ".join(fields))
