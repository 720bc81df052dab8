"""Substring dedup: repeated token windows merge into maximal removal intervals.

Every window of ``width`` consecutive words gets a Rabin-Karp hash (prefix sums modulo 2**64). Windows are dealt to
buckets by the smallest hash of the short spans they hold, so neighbouring windows share a bucket, equal windows always
do, and a run of windows travels as a few bytes a window. A bucket finds for each hash the smallest ``doc_id``; windows
of larger ids are repeated, and adjacent ones leave it as one interval. Spark groups the intervals of each document.

A map task sends only the windows of the smallest id that it saw for a hash: the others are already known to be repeated,
so a passage that a third of the documents share arrives once per batch. Windows that differ but share a frequent short
span would still fill one bucket, so the windows of every bucket are counted first, in a pass of its own over the texts;
one of more than twice the mean is divided by the window hash, and equal windows still meet. Bucket memory is so bounded
by the bucket count, a multiple of ``spark.sql.shuffle.partitions``.

Equality is judged on ``56 + log2(buckets)`` hash bits: about ``n**2 / 2**(57 + log2(buckets))`` windows of ``n`` would be
taken for repeats by accident, 1e-3 in 10 billion windows with 4,096 buckets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.text import batch_bytes, mix, slices, window_hashes, word_hashes

WIDTH = 50
#: Words of the short spans whose smallest hash names a window's bucket.
SPAN = 5
#: Bytes of a window hash that travel; the bucket number adds the rest.
KEPT = 7
BUCKETS_PER_PARTITION = 4
#: Windows that a bucket may always hold undivided.
LEAST_WINDOWS = 8_192

BLOBS = "bucket int, hashes binary, places binary, docs binary, intervals binary"
INTERVALS = pa.schema([("_id", pa.int64()), ("_row", pa.int64()), ("first", pa.int32()), ("stop", pa.int32())])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _pack(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=dtype)


def _runs(group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring places inside one group."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero((np.diff(at) != 1) | (group[1:] != group[:-1])) + 1
    return np.concatenate(([0], new)), np.concatenate((new - 1, [len(at) - 1]))


def _repeated(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """True where the hash also occurs with a smaller id."""
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1])))
    smallest = np.minimum.reduceat(ids[order], starts)
    out = np.empty(len(hashes), dtype=bool)
    out[order] = ids[order] > np.repeat(smallest, np.diff(np.append(starts, len(hashes))))
    return out


def _windows(batch: pa.RecordBatch, buckets: int, width: int):
    """Hash, document, place, bucket of each window, whether a smaller id in the batch has it too, and all first words."""
    data, bounds = batch_bytes(batch.column(2))
    hashed, first = word_hashes(data, bounds)
    windows, at, doc = window_hashes(hashed, first, width)
    if not len(windows):
        return None
    span = min(SPAN, width)
    short, short_at, _ = window_hashes(hashed, first, span)
    # Short spans lie in document order too; a window's own ones are neighbours.
    where = np.searchsorted(short_at, at)
    anchor = _sliding_min(short, width - span + 1)[where]
    bucket = (mix(anchor) % np.uint64(buckets)).astype(np.int32)
    return windows, at, doc, bucket, _repeated(windows, batch.column(0).to_numpy(zero_copy_only=False)[doc]), first


def _count(buckets: int, width: int):
    """Windows that a task sends to each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for some in slices(batch, "_text"):
                if (found := _windows(some, buckets, width)) is not None:
                    total += np.bincount(found[3][~found[4]], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return run


def crowded(rows: DataFrame, buckets: int, width: int) -> dict[int, int]:
    """Parts of each bucket of more than twice the mean number of windows. A count per bucket comes to the driver."""
    sizes = rows.mapInArrow(_count(buckets, width), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    names, n = sizes.column("bucket").to_numpy(), sizes.column("n").to_numpy()
    mean = max(n.sum() / buckets, LEAST_WINDOWS)
    return {int(b): math.ceil(k / mean) for b, k in zip(names, n) if k > 2 * mean}


def _spread(buckets: int, width: int, parts: dict[int, int] | None = None):
    # A divided bucket keeps its number for its first part; the others are numbered behind all buckets.
    split = np.ones(buckets, dtype=np.int64)
    for b, n in (parts or {}).items():
        split[b] = n
    behind = buckets + np.cumsum(split - 1) - split

    def part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if (found := _windows(batch, buckets, width)) is None:
            return
        windows, at, doc, bucket, known, first = found
        if parts:
            share = (mix(windows) % split[bucket].astype(np.uint64)).astype(np.int64)
            bucket = np.where(share > 0, behind[bucket] + share, bucket).astype(np.int32)
        place = at - first[doc]
        cut = np.flatnonzero(known)
        a, b = _runs(doc[cut], at[cut])
        local = np.stack([ids[doc[cut[a]]], rows[doc[cut[a]]], place[cut[a]], place[cut[b]] + width]) if len(a) else None
        sent = np.flatnonzero(~known)
        order = sent[np.argsort(bucket[sent], kind="stable")]
        edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
        names, hashes, places, docs, done = [], [], [], [], []
        for low, high in zip(edges[:-1], edges[1:]):
            mine = order[low:high]
            inside, counts = np.unique(doc[mine], return_counts=True)
            table = np.stack([ids[inside], rows[inside], counts])
            names.append(int(bucket[mine[0]]))
            hashes.append(windows[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes())
            places.append(_pack(np.diff(place[mine], prepend=0).astype("<i4")))
            docs.append(_pack(np.diff(table, axis=1, prepend=0).astype("<i8")))
            done.append(None)
        if local is not None:
            names.append(int(mix(np.array([ids[0]], dtype=np.int64).view(np.uint64))[0] % np.uint64(buckets)))
            hashes.append(None), places.append(None), docs.append(None)
            done.append(_pack(local.astype("<i8")))
        yield pa.record_batch([pa.array(names, pa.int32()), pa.array(hashes, pa.binary()), pa.array(places, pa.binary()),
                               pa.array(docs, pa.binary()), pa.array(done, pa.binary())],
                              names=["bucket", "hashes", "places", "docs", "intervals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "_text"):
                yield from part(some)

    return run


def _table(ids, rows, first, stop) -> pa.Table:
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()),
                                 pa.array(first, pa.int32()), pa.array(stop, pa.int32())], schema=INTERVALS)


def _gather(width: int):
    def run(table: pa.Table) -> pa.Table:
        found, hashes, ids, rows, places = [], [], [], [], []
        for blob, place, docs, done in zip(*(table.column(n).to_pylist() for n in ("hashes", "places", "docs", "intervals"))):
            if done is not None:
                found.append(_unpack(done, "<i8").reshape(4, -1))
                continue
            n = len(blob) // KEPT
            wide = np.zeros((n, 8), dtype=np.uint8)
            wide[:, :KEPT] = np.frombuffer(blob, dtype=np.uint8).reshape(n, KEPT)
            hashes.append(wide.view("<u8").ravel())
            known = np.cumsum(_unpack(docs, "<i8").reshape(3, -1), axis=1)
            ids.append(np.repeat(known[0], known[2]))
            rows.append(np.repeat(known[1], known[2]))
            places.append(np.cumsum(_unpack(place, "<i4").astype(np.int64)))
        if hashes:
            hashes, ids, rows, places = (np.concatenate(x) for x in (hashes, ids, rows, places))
            cut = np.flatnonzero(_repeated(hashes, ids))
            if len(cut):
                a, b = _runs(rows[cut] ^ ids[cut], places[cut])
                found.append(np.stack([ids[cut[a]], rows[cut[a]], places[cut[a]], places[cut[b]] + width]))
        merged = np.concatenate(found, axis=1) if found else np.zeros((4, 0), dtype=np.int64)
        return _table(*merged)

    return run


def repeated_intervals(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                       buckets: int | None = None) -> DataFrame:
    """``(_id, _row, first, stop)``: word ranges whose windows also start in a document with a smaller key.

    ``_row`` is a hash of the text and tells rows apart that share a key.
    """
    spark = docs.sparkSession
    buckets = buckets or BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_row"), F.col(text).cast("binary").alias("_text"))
    blobs = rows.mapInArrow(_spread(buckets, width, crowded(rows, buckets, width)), BLOBS)
    return blobs.groupBy("bucket").applyInArrow(_gather(width), "_id long, _row long, first int, stop int")


OUT = ["kept_text", "n_words", "n_removed"]


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("_text"))
            cuts = batch.column(batch.schema.get_field_index("_cuts"))
            kept, total, gone = [], [], []
            for i in range(batch.num_rows):
                found = (text[i].as_py() or b"").split()
                n = len(found)
                ranges = cuts[i].as_py()
                if ranges:
                    stay = np.ones(n, dtype=bool)
                    for r in ranges:
                        stay[r["first"]: r["stop"]] = False
                    found = [found[j] for j in np.flatnonzero(stay)]
                kept.append(b" ".join(found))
                total.append(n)
                gone.append(n - len(found))
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            # The words come from valid UTF-8 and are cut at ASCII bytes only.
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.record_batch([*arrays, texts, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, *OUT])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
                   width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """``key``, the ``keep`` columns, ``kept_text``, ``n_words`` and ``n_removed`` of every row.

    A word goes if a window over it has a word sequence that also starts in a document with a smaller key. Windows are
    judged on the input. Kept words are joined by one space. Rows with a null key neither lose words nor take any from
    others; a null or blank text has no words. Rows that share a key don't remove from each other; repeated rows get the
    same result each. Columns other than the named ones are ignored; kept ones must not carry an output's name. An empty table
    gives no rows.
    """
    cuts = repeated_intervals(docs, key, text, width, buckets).groupBy("_id", "_row").agg(
        F.collect_list(F.struct("first", "stop")).alias("_cuts"))
    rows = docs.select(F.col(key), *keep, F.col(key).cast("long").alias("_id"),
                       F.xxhash64(text).alias("_row"), F.col(text).cast("binary").alias("_text"))
    joined = rows.join(cuts, ["_id", "_row"], "left").select(key, *keep, "_text", "_cuts")
    names = [key, *keep]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*names).schema.fields)
    return joined.mapInArrow(_cut(names), f"{fields}, kept_text string, n_words long, n_removed long")
