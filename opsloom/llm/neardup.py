"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

1. Document frequencies of five-word shingles: every shingle of every text counts into a table of ``CELLS`` hash cells. Its
   size is fixed (8 MB of counters), so it may be broadcast; what a cell holds beside its shingle is about shingles per
   document / ``CELLS`` of the corpus, the same share at every size.
2. A shingle weighs ``tf * (1 + SPAN * ln((N + 1) / (df + 1)) / ln(N + 1))``: rare ones up to half as much again as common
   ones. The bound keeps a large group of near copies from pushing its own shared shingles out of the comparison.
3. ``HASHES`` consistent weighted samples per text; two texts share one with probability equal to their weighted Jaccard
   similarity. ``ROWS`` samples make a band: a pair at 0.8 meets in one of the bands with probability 0.9998.
4. Nodes are distinct texts (by digest). In each bucket the members meet its most shared node: among near copies, the one
   nearest to what they have in common. Pairs that agree in enough of their samples (a pair at the threshold does, but for
   1 in 200,000) are verified: true weighted Jaccard of at least ``SIMILARITY`` makes a link. In buckets whose members are
   then still in several components, those outside the largest one meet another of its nodes, in each band another one.
   The rest is compared whole: all members of such a bucket by their samples, and then, inside the sets that agreement
   holds together, all texts outside the largest component with all others, by their true similarity.
5. Components of the links, and copies through the digest, give each document its class.

A bucket is never gathered: stars are salted by the number of members, samples are compared in blocks of ``WIDE`` texts (144
bytes each) and features in blocks of ``BLOCK``. Texts that share a frequent passage without being near copies meet only in a
numpy comparison of samples. Tasks give the links that join components, never all pairs. Only the features of texts that
share a bucket are written out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.graph import components, stored
from opsloom.llm.text import batch_bytes, mix, slices, window_hashes, word_hashes
from opsloom.session import work_path

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 3, 12
HASHES = ROWS * BANDS
CELLS = 1 << 21
SLICE_CELLS = 1 << 16
BLOCK = 512
#: How much more the rarest shingle weighs than the commonest.
SPAN = 0.5
#: Rounds of further stars before all members are compared, and members in a block of samples then.
ROUNDS = 1
WIDE = 2_048
#: Texts, or members of buckets, that one task takes in the steps between.
TASK_ROWS = 65_536
#: Bits of a shingle's fingerprint inside one batch; the rest numbers its text.
FINGERPRINT = np.uint64(44)
MOST_ROWS = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(104_729))
_STEPS = 1 << 16
_R = _RNG.gamma(2.0, 1.0, _STEPS).astype(np.float32)
_LOG_C = np.log(_RNG.gamma(2.0, 1.0, _STEPS)).astype(np.float32)
_SEEDS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, count and document of each distinct shingle; a text of one to four words is one shingle itself."""
    data, bounds = batch_bytes(texts)
    hashed, first = word_hashes(data, bounds)
    found, _, doc = window_hashes(hashed, first, SHINGLE)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = [int(mix(np.array([np.bitwise_xor.reduce(mix(hashed[first[d]:first[d + 1]] + np.arange(counts[d], dtype=np.uint64)))],
                                  dtype=np.uint64))[0]) for d in short]
        found, doc = np.concatenate((found, np.array(whole, dtype=np.uint64))), np.concatenate((doc, short))
    keys = np.sort(doc.astype(np.uint64) << FINGERPRINT | found >> np.uint64(64 - int(FINGERPRINT)))
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    each = np.diff(np.append(at, len(keys)))
    return keys[at] & np.uint64((1 << int(FINGERPRINT)) - 1), each, (keys[at] >> FINGERPRINT).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(CELLS, dtype=np.int32)
    for batch in batches:
        for some in slices(batch, "_text"):
            prints, _, _ = shingles(some.column(0))
            cells += np.bincount((prints % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.int32)
    names, packed = [], []
    for k in range(CELLS // SLICE_CELLS):
        part = cells[k * SLICE_CELLS:(k + 1) * SLICE_CELLS]
        if part.any():
            names.append(k)
            packed.append(zlib.compress(part.astype("<i8").tobytes(), 1))
    yield pa.record_batch([pa.array(names, pa.int32()), pa.array(packed, pa.binary())], names=["slice", "cells"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(zlib.decompress(packed.as_py()), dtype="<i8")
            sums[k] = sums[k] + part if k in sums else part
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())],
                          names=["slice", "cells"])


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Documents per cell, over all documents: one array of fixed size."""
    parts = rows.select("_text").mapInArrow(_count, "slice int, cells binary")
    summed = parts.repartition(CELLS // SLICE_CELLS, "slice").mapInArrow(_add, "slice int, cells binary")
    cells = np.zeros(CELLS, dtype=np.int64)
    for row in summed.collect():  # 32 rows, however large the corpus
        cells[row["slice"] * SLICE_CELLS:(row["slice"] + 1) * SLICE_CELLS] = np.frombuffer(zlib.decompress(row["cells"]), dtype="<i8")
    return cells


def idf(cells: np.ndarray, documents: int) -> np.ndarray:
    most = math.log(documents + 1) or 1.0
    return (1.0 + SPAN * np.log((documents + 1) / (np.minimum(cells, documents) + 1)) / most).astype(np.float32)


def signatures(prints: np.ndarray, weights: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``HASHES`` samples per text, as hashes of (shingle, level); texts without shingles are marked false."""
    present = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros((n, HASHES), dtype=np.uint64)
    has = np.zeros(n, dtype=bool)
    if not len(present):
        return out, has
    has[doc[present]] = True
    log_weight = np.log(weights).astype(np.float32)
    base = mix(prints + np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64(0xFFFF)
    for k in range(HASHES):
        h = base * _SEEDS[k]
        h ^= h >> np.uint64(29)
        r = _R[h & low]
        beta = ((h >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
        level = np.floor(log_weight / r + beta)
        value = _LOG_C[(h >> np.uint64(40)) & low] - r * (level - beta + np.float32(1.0))
        # Float order as integer order, with a hash of (shingle, level) below: one minimum finds value and sample.
        bits = value.view(np.int32).astype(np.int64)
        bits = np.where(bits < 0, ~bits & 0xFFFFFFFF, bits | 0x80000000).astype(np.uint64)
        sample = mix(prints ^ (level.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) & np.uint64(0xFFFFFFFF)
        out[doc[present], k] = np.minimum.reduceat(bits << np.uint64(32) | sample, present)
    return out, has


def _bands(weights) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            for some in slices(batch, "_text"):
                for at in range(0, some.num_rows, MOST_ROWS):
                    part = some.slice(at, MOST_ROWS)
                    prints, counts, doc = shingles(part.column(1))
                    weight = counts.astype(np.float32) * table[(prints % np.uint64(CELLS)).astype(np.int64)]
                    samples, has = signatures(prints, weight, doc, part.num_rows)
                    keys = np.zeros((part.num_rows, BANDS), dtype=np.uint64)
                    for r in range(ROWS):
                        keys = mix(keys * np.uint64(31) + samples[:, r::ROWS])
                    low = (samples[has] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                    listed = lambda values, n, kind: pa.FixedSizeListArray.from_arrays(
                        pa.array(np.ascontiguousarray(values).ravel()), n).cast(pa.list_(kind))
                    yield pa.record_batch([part.column(0).filter(pa.array(has)), listed(keys[has].view(np.int64), BANDS, pa.int64()),
                                           listed(low, HASHES, pa.int32())], names=["node", "bands", "samples"])

    return run


def _features(weights) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            for some in slices(batch, "_text"):
                prints, counts, doc = shingles(some.column(1))
                weight = counts.astype(np.float32) * table[(prints % np.uint64(CELLS)).astype(np.int64)]
                edges = np.searchsorted(doc, np.arange(some.num_rows + 1))
                yield pa.record_batch([some.column(0),
                                       pa.array([prints[a:b].astype("<u8").tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                                       pa.array([weight[a:b].astype("<f4").tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())],
                                      names=["node", "prints", "weights"])

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima; the fingerprints are sorted and distinct."""
    both = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64)
    return shared / (both - shared)


def enough(similarity: float) -> int:
    """Samples in which a pair of at least this similarity agrees, but for 4.5 standard deviations."""
    return max(1, math.floor(HASHES * similarity - 4.5 * math.sqrt(HASHES * similarity * (1 - similarity))))


def _agreeing(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, hub) whose samples agree often enough."""
    named = signed.select("node", "samples")
    both = pairs.join(named, "node").join(named.select(F.col("node").alias("hub"), F.col("samples").alias("_s")), "hub")
    same = F.aggregate(F.zip_with("samples", "_s", lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return both.where(same >= enough(similarity)).select("node", "hub")


def _block(table: pa.Table):
    """Nodes, roots (as names and numbers), samples, and the rows of both sides of a block pair."""
    table = table.combine_chunks()
    names, roots = np.unique(np.array(table.column("root").to_pylist(), dtype=object), return_inverse=True)
    samples = table.column("samples").combine_chunks().flatten().to_numpy().reshape(table.num_rows, HASHES)
    side = table.column("side").to_numpy()
    return table, names, roots.ravel(), samples, np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _agreement(samples: np.ndarray, row: int, others: np.ndarray) -> np.ndarray:
    return (samples[others] == samples[row]).sum(axis=1)


def _forest(need: int):
    """Edges between the roots of a block pair that hold together what agrees in ``need`` samples."""

    def run(table: pa.Table) -> pa.Table:
        _, names, roots, samples, mine, others = _block(table)
        label = np.arange(len(names))
        left, right = [], []
        for i in mine:
            near = np.unique(label[roots[others[_agreement(samples, i, others) >= need]]])
            own = label[roots[i]]
            near = near[near != own]
            if len(near):
                left += [names[roots[i]]] * len(near)
                right += names[near].tolist()
                label[np.isin(label, near)] = own
        return pa.table([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["u", "v"])

    return run


def _exact(need: int, similarity: float):
    """Links between the two sides of a block pair that join components."""

    def run(table: pa.Table) -> pa.Table:
        table, names, roots, samples, mine, others = _block(table)
        nodes = table.column("node").to_pylist()
        features = [(np.frombuffer(p.as_py(), "<u8"), np.frombuffer(w.as_py(), "<f4"))
                    for p, w in zip(table.column("prints"), table.column("weights"))]
        totals = np.array([w.sum(dtype=np.float64) for _, w in features])
        label = np.arange(len(names))
        left, right = [], []
        for i in mine:
            fits = np.minimum(totals[others], totals[i]) >= similarity * np.maximum(totals[others], totals[i])
            fits &= _agreement(samples, i, others) >= need
            for j in others[fits]:
                a, b = label[roots[i]], label[roots[j]]
                if a != b and weighted_jaccard(features[i], features[j]) >= similarity:
                    left.append(nodes[i]), right.append(nodes[j])
                    label[label == b] = a
        return pa.table([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["u", "v"])

    return run


def _verify(similarity: float):
    """Links between the hub of a group and its members."""

    def run(table: pa.Table) -> pa.Table:
        nodes = [x.as_py() for x in table.column("node")]
        sides = table.column("side").to_pylist()
        features = [(np.frombuffer(p.as_py(), "<u8"), np.frombuffer(w.as_py(), "<f4"))
                    for p, w in zip(table.column("prints"), table.column("weights"))]
        totals = [float(w.sum(dtype=np.float64)) for _, w in features]
        left, right = [], []
        members = [j for j, side in enumerate(sides) if side == 1]
        for i in (i for i, side in enumerate(sides) if side == 0):
            for j in members:
                if min(totals[i], totals[j]) >= similarity * max(totals[i], totals[j]) and nodes[i] != nodes[j]:
                    if weighted_jaccard(features[i], features[j]) >= similarity:
                        left.append(nodes[i]), right.append(nodes[j])
        return pa.table([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["u", "v"])

    return run


def _links(pairs: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """Verified links of the pairs (node, hub)."""
    groups = _salted(stored(pairs))
    return groups.join(features, "node").groupBy("g").applyInArrow(_verify(similarity), "u binary, v binary")


def _stars(members: DataFrame) -> DataFrame:
    """Each member with its bucket's most shared node, once per pair."""
    hubs = members.groupBy("band", "key").agg(F.max(F.struct("shared", "node"))["node"].alias("hub"))
    return members.join(hubs, ["band", "key"]).where("node <> hub").select("node", "hub").distinct()


def _salted(pairs: DataFrame) -> DataFrame:
    """Groups of at most about ``BLOCK`` members with their hub."""
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK))
    salted = pairs.join(sizes, "hub").select(F.struct("hub", F.pmod(F.xxhash64("node"), "parts").alias("part")).alias("k"), "node")
    first = salted.select("k", "node", F.lit(1).alias("side"))
    hub_rows = sizes.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "hub").select(
        F.struct("hub", "part").alias("k"), F.col("hub").alias("node"), F.lit(0).alias("side"))
    return first.union(hub_rows).withColumn("g", F.xxhash64("k.hub", "k.part")).drop("k")


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with the root of their component."""
    named = roots.withColumnRenamed("node", "_n")
    return members.join(named, members["node"] == named["_n"], "left").drop("_n").withColumn("root", F.coalesce("root", "node"))


def _open(placed: DataFrame) -> DataFrame:
    """Buckets with several components: the largest one (``top``), the number of members and a hash of them."""
    by_root = placed.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h"))
    return by_root.groupBy("band", "key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("top"),
                                              F.sum("n").alias("n"), F.sum("h").alias("h")).where("roots > 1")


def _again(placed: DataFrame, number: int) -> DataFrame:
    """Members outside their bucket's largest component, with a node of it that changes with band and round."""
    rows = placed.join(_open(placed).select("band", "key", "top"), ["band", "key"])
    hubs = rows.where(F.col("root") == F.col("top.root")).groupBy("band", "key").agg(
        F.min_by("node", F.xxhash64("node", "band", F.lit(number))).alias("hub"))
    return rows.where(F.col("root") != F.col("top.root")).join(hubs, ["band", "key"]).select("node", "hub").distinct()


def _block_pairs(rows: DataFrame, sets: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``(g, node, side, root)``: the members outside each set's largest component, in blocks, beside all its members.

    ``sets`` has for each of its ``keys`` the members ``n`` and the largest component ``top`` (n, root).
    """
    all_ = rows.join(sets.select(*keys, "n", "top"), keys).withColumn("few", F.col("root") != F.col("top.root"))
    size, few_size = F.ceil(F.col("n") / width), F.ceil((F.col("n") - F.col("top.n")) / width)
    block = lambda parts: F.pmod(F.xxhash64("node"), parts)
    zero = F.lit(0).cast("long")
    name = lambda i, j: F.xxhash64(*keys, i, j)
    ones = all_.withColumn("i", F.explode(F.sequence(zero, few_size - 1))).select(
        name(F.col("i"), block(size)).alias("g"), "node", F.lit(1).alias("side"), "root")
    zeros = all_.where("few").withColumn("j", F.explode(F.sequence(zero, size - 1))).select(
        name(block(few_size), F.col("j")).alias("g"), "node", F.lit(0).alias("side"), "root")
    return ones.union(zeros)


def _rest(placed: DataFrame, signed: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """Links that the stars did not find, from all members of the buckets with several components.

    Buckets with the same members are compared once. Agreement ties their components into sets; each set, wherever its
    buckets lie, is then compared once by true similarity.
    """
    need, samples = enough(similarity), signed.select("node", "samples")
    once = _open(placed).groupBy("n", "h").agg(F.min(F.struct("band", "key", "top", "n")).alias("b")).select("b.*")
    pairs = _block_pairs(placed.select("band", "key", "node", "root"), once, ["band", "key"], WIDE)
    forest = pairs.join(samples, "node").groupBy("g").applyInArrow(_forest(need), "u binary, v binary")
    sets = components(forest).select(F.col("node").alias("root"), F.col("root").alias("set"))
    rows = stored(placed.select("node", "root").distinct().join(sets, "root").select("set", "node", "root"), TASK_ROWS)
    by_root = rows.groupBy("set", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = by_root.groupBy("set").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    groups = _block_pairs(rows, sizes, ["set"], BLOCK)
    return groups.join(samples, "node").join(features, "node").groupBy("g").applyInArrow(_exact(need, similarity), "u binary, v binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
                    similarity: float = SIMILARITY) -> DataFrame:
    """``key``, the ``keep`` columns, ``node`` (digest of the text) and ``class_id``, the smallest key of its class.

    Rows with the same text are in one class; so are texts linked by weighted Jaccard similarity of at least
    ``similarity``, directly or in a chain. Null texts and texts without a word are alone: ``class_id`` is the row's own
    key. Keys may be null or repeated; a class whose keys are all null has a null id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    blank = F.coalesce(F.length(F.btrim(F.col(text), F.lit("\t\n\x0b\x0c\r "))), F.lit(0)) == 0
    node = F.when(~blank, F.unhex(F.md5(F.col(text))))
    rows = docs.where(~blank).select(node.alias("node"), F.col(text).cast("binary").alias("_text"))

    cells = document_frequencies(rows)
    documents = max(1, rows.count())
    weights = spark.sparkContext.broadcast(idf(cells, documents))

    signed = stored(rows.mapInArrow(_bands(weights), "node binary, bands array<bigint>, samples array<int>").dropDuplicates(["node"]), TASK_ROWS)
    banded = signed.select("node", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = banded.join(shared, ["band", "key"])
    popular = members.groupBy("node").agg(F.sum("n").alias("shared"))
    members = stored(members.drop("n").join(popular, "node"), TASK_ROWS)
    wanted = members.select("node").distinct()
    path = work_path(spark, "features")
    # Copies go before the shuffle, so that a hot text arrives once per map task.
    rows.dropDuplicates(["node"]).join(wanted, "node", "left_semi").select("node", "_text").mapInArrow(
        _features(weights), "node binary, prints binary, weights binary").write.parquet(path)
    features = spark.read.parquet(path)

    links = stored(_links(_agreeing(_stars(members), signed, similarity), features, similarity))
    roots = components(links)
    number = 0
    while number <= ROUNDS:
        placed = stored(_placed(members, roots), TASK_ROWS)
        if number < ROUNDS:
            found = _links(_agreeing(_again(placed, number), signed, similarity), features, similarity)
        else:
            found = _rest(placed, signed, features, similarity)
        found = stored(found)
        if found.take(1):
            # Roots stand for what they hold: only the new links need a walk.
            links = stored(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found))
            roots = components(links)
        number = number + 1 if found.take(1) or number == ROUNDS else ROUNDS

    joined = docs.select(F.col(key), *keep, node.alias("node"))
    placed = joined.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n")
    placed = placed.withColumn("_class", F.coalesce("root", "node")).drop("root")
    ids = placed.where("_class IS NOT NULL").groupBy("_class").agg(F.min(key).alias("_id"))
    return placed.join(ids, "_class", "left").withColumn(
        "class_id", F.when(F.col("_class").isNull(), F.col(key)).otherwise(F.col("_id"))).drop("_class", "_id")


def first_of_class(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that have the smallest key of their class, one row per class; blank texts all stay.

    Columns of ``docs`` must not begin with ``_near_``.
    """
    columns = docs.columns
    classes = near_duplicates(docs, key, text, similarity=similarity)
    # Equal keys with equal texts are repeated rows: one of them stays.
    keepers = classes.where(F.col("node").isNotNull() & F.col(key).eqNullSafe(F.col("class_id"))).groupBy(
        F.col("class_id").alias("_near_id")).agg(F.min("node").alias("_near_node"))
    marked = docs.withColumn("_near_text", F.when(
        F.length(F.btrim(F.col(text), F.lit("\t\n\x0b\x0c\r "))) > 0, F.unhex(F.md5(F.col(text)))))
    blank = marked.where("_near_text IS NULL")
    stay = marked.join(keepers, F.col(key).eqNullSafe(F.col("_near_id")) & (F.col("_near_text") == F.col("_near_node")))
    return stay.dropDuplicates(["_near_id", "_near_node"]).select(*columns).unionByName(blank.select(*columns))
