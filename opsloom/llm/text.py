"""Words, word hashes and rolling window hashes, shared by the operators of this package.

A word is a maximal run of characters other than ``\\x20`` and ``\\x09-\\x0D``. The Spark form builds an
array column; the numpy form works on the UTF-8 bytes of a whole Arrow batch, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r "
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Bytes hashed at a time: bounds the memory of the prefix sums.
SEGMENT = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(7_919))
_BYTE = _RNG.integers(0, 2**64 - 1, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLES: list[np.ndarray] = []


def words(text: str | Column) -> Column:
    """Array of the words of a text; empty for a null, empty or blank text."""
    c = F.col(text) if isinstance(text, str) else text
    inner = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS))


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, SEGMENT + 4096)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _TABLES[:] = tables
    return _TABLES[0], _TABLES[1]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[s:e]`` for each pair, by prefix sums; pairs ascend by start. Empty ranges give 0."""
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(starts, low + SEGMENT, side="left")))
        high = int(ends[at:stop].max())
        power, inverse = _powers(high - low + 1)
        prefix = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(values[low:high] * power[: high - low], out=prefix[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (prefix[e] - prefix[s]) * inverse[s]
        at = stop
    return out


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranges of ``values`` behind one another."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of the documents, and each document's first word (one more at the end)."""
    inside = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, bounds, side="left")


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words of at most about SEGMENT bytes; a longer word is a range of its own."""
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, side="right")))
        yield at, stop
        at = stop


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and each document's first word (one more at the end)."""
    starts, ends, first = spans(data, bounds)
    out = np.empty(len(starts), dtype=np.uint64)
    for a, b in segments(data, starts, ends):
        low, high = int(starts[a]), int(ends[b - 1])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix(rolling(_BYTE[data[low:high]], s, e) + (e - s).astype(np.uint64))
    return out, first


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and document index of each window of ``width`` words inside one document."""
    counts = np.diff(first)
    per_doc = np.maximum(counts - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), per_doc)
    skipped = np.cumsum(counts - per_doc) - (counts - per_doc)
    at = np.arange(len(doc)) + np.repeat(skipped, per_doc) + int(first[0] if len(first) else 0)
    return mix(rolling(hashes, at, at + width)), at, doc


def batch_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document bounds of a binary column; nulls are empty. No copy unless the column has chunks or nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[bounds[0]: bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about ``limit`` bytes of text each; a longer text is a part of its own."""
    _, bounds = batch_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
