"""BPE encoding and decoding with contiguous rank arrays.

A word is an array of parts and an array with the merge rank of each pair of neighbours. A round scans the ranks for the
minimum (the leftmost of equals), deletes the boundary there, and looks up the two ranks that changed; it ends when no
neighbours merge. Many short words of equal padding go through the rounds together as rows of a matrix. Words above
``LONG`` parts keep the same order of merges with a heap, since repeated scans would be quadratic.

The word splitter follows the vocabulary file: NFC, white space to one space, lower case, then letters, single digits and
runs of other characters, as UTF-8 bytes in the usual printable alphabet, with an end-of-word mark. Words repeat, so each
worker remembers what it has encoded, up to a bounded number of entries.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.text import gather

#: Words longer than this many parts are merged with a heap.
LONG = 128
CACHE = 100_000
#: Runs encoded at a time: bounds the Python objects that exist at once.
LEARN = 1 << 13
#: Text encoded at a time.
SLICE = 1 << 19

NONE = np.int64(1) << 40
#: Unicode white space; ``str.split`` also cuts at U+001C to U+001F, which are not.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_NOT_WHITE = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character of each byte value: itself where it prints, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary file (tokenizers' JSON) with an end-of-word suffix and its own splitting pattern."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        ids = model["vocab"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        chars = byte_alphabet()
        self.inner = np.array([ids[c] for c in chars], dtype=np.int64)
        self.final = np.array([ids[c + self.suffix] for c in chars], dtype=np.int64)
        pairs = [(ids[a] << 20 | ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])]
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._pairs = None

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair, as ``rank << 20 | id``; NONE where the pair doesn't merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at] << 20 | self.merged[at], NONE)

    def words(self, chunk: str) -> list[str]:
        """Words of a run of text without white space."""
        if not chunk.isascii():
            # One character at a time: a capital sigma always becomes the same letter.
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        chunk = chunk.lower()
        return [chunk] if chunk.isalpha() else self.pattern.findall(chunk)

    def merge_many(self, words: Sequence[bytes]) -> list[np.ndarray]:
        """Token ids of each word, given as UTF-8 bytes."""
        out: list[np.ndarray] = [None] * len(words)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, 40), (40, LONG)):
            mine = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(mine), 8192):
                self._short(words, mine[at:at + 8192], high, lengths, out)
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self._long(words[i])
        return out

    def _short(self, words, mine, width, lengths, out) -> None:
        size = lengths[mine]
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in mine), dtype=np.uint8).reshape(len(mine), width)
        column = np.arange(width)
        parts = self.inner[raw]
        last = size - 1
        rows = np.arange(len(mine))
        parts[rows, last] = self.final[raw[rows, last]]
        parts[column[None, :] >= size[:, None]] = -1
        ranks = np.full((len(mine), width), NONE)
        if width > 1:
            ranks[:, :-1] = np.where(parts[:, 1:] >= 0, self.lookup(parts[:, :-1], np.maximum(parts[:, 1:], 0)), NONE)
        where = mine
        while True:
            least = ranks.argmin(axis=1)
            value = ranks[np.arange(len(where)), least]
            done = value == NONE
            if done.any():
                for i, row in zip(where[done], parts[done]):
                    out[i] = row[row >= 0].astype("<u4")
                go = ~done
                where, parts, ranks, least, value = where[go], parts[go], ranks[go], least[go], value[go]
            if not len(where):
                return
            rows = np.arange(len(where))
            # Delete the boundary behind ``least``: all that follows moves up by one place.
            source = np.minimum(column[None, :] + (column[None, :] > least[:, None]), width - 1)
            parts, ranks = np.take_along_axis(parts, source, 1), np.take_along_axis(ranks, source, 1)
            parts[:, -1], ranks[:, -1] = -1, NONE
            parts[rows, least] = value & ((1 << 20) - 1)
            after = np.where(least + 1 < width, parts[rows, np.minimum(least + 1, width - 1)], -1)
            ranks[rows, least] = np.where(after >= 0, self.lookup(parts[rows, least], np.maximum(after, 0)), NONE)
            back = np.flatnonzero(least > 0)
            before = least[back] - 1
            ranks[back, before] = self.lookup(parts[back, before], parts[back, least[back]])

    def _long(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, dtype=np.uint8)
        parts = self.inner[raw]
        parts[-1] = self.final[raw[-1]]
        parts = parts.tolist()
        if self._pairs is None:
            self._pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))
        pairs = self._pairs
        following, previous = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(p[0], i, parts[i], parts[i + 1], p[1]) for i in range(len(parts) - 1) if (p := pairs.get(parts[i] << 20 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = following[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            following[i] = k = following[j]
            if k < len(parts):
                previous[k] = i
                if p := pairs.get(new << 20 | parts[k]):
                    heapq.heappush(heap, (p[0], i, new, parts[k], p[1]))
            h = previous[i]
            if h >= 0 and (p := pairs.get(parts[h] << 20 | new)):
                heapq.heappush(heap, (p[0], h, parts[h], new, p[1]))
        return np.array([x for x in parts if x >= 0], dtype="<u4")


class Encoder:
    """Ids and decoded form of texts; remembers runs without white space.

    Known runs are a table of Arrow strings with their ids in one array and their decoded forms in another, a fraction of
    the memory of Python objects. Beyond the bound, the half that was used last stays.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        self.vocabulary = Vocabulary(path)
        self.limit = cache
        special = self.vocabulary.special
        # The special tokens come first and stay.
        self.known = pa.array(list(special), pa.large_string())
        self.ids = np.array(list(special.values()), dtype="<u4")
        self.shown = pa.array([self.vocabulary.tokens[i] for i in special.values()], pa.large_string())
        self.sizes, self.used, self.turn = np.ones(len(special), dtype=np.int64), np.zeros(len(special), dtype=np.int64), 0

    def runs(self, text: str) -> list[str]:
        """Special tokens and runs without white space, in order."""
        pieces = self.vocabulary.split_special.split(text) if "<|" in text else (text,)
        out: list[str] = []
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(piece)
            elif _NOT_WHITE.search(piece):
                out += [x for x in _WHITE.split(piece) if x]
            else:
                out += piece.split()
        return out

    def _spell(self, runs: Sequence[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of the runs, one after another, how many each has, and their decoded forms."""
        words = [self.vocabulary.words(r) for r in runs]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        found = self.vocabulary.merge_many([w.encode() for w in distinct])
        tokens = self.vocabulary.tokens
        shown = [" ".join([tokens[t] for t in ids.tolist()]) for ids in found]
        sizes = np.array([len(ids) for ids in found], dtype=np.int64)
        flat = np.array([distinct[w] for ws in words for w in ws], dtype=np.int64)
        upto = np.concatenate(([0], np.cumsum(sizes[flat])))
        ends = np.cumsum([len(ws) for ws in words])
        ids = gather(np.concatenate([self.ids[:0], *found]), (np.cumsum(sizes) - sizes)[flat], sizes[flat])
        return ids, np.diff(upto[ends], prepend=0), pa.array([" ".join([shown[distinct[w]] for w in ws]) for ws in words], pa.large_string())

    def _learn(self, runs: pa.Array) -> None:
        """Add different unknown runs to the table, some at a time."""
        ids, sizes, shown = zip(*(self._spell(runs.slice(at, LEARN).to_pylist()) for at in range(0, len(runs), LEARN)))
        self.ids = np.concatenate([self.ids, *ids])
        self.sizes = np.concatenate([self.sizes, *sizes])
        self.used = np.concatenate([self.used, np.zeros(len(runs), dtype=np.int64)])
        self.known = pa.concat_arrays([self.known, runs])
        self.shown = pa.concat_arrays([self.shown, *shown])

    def _forget(self) -> None:
        """Keep the special tokens and the half of the table that was used last."""
        first = len(self.vocabulary.special)
        kept = np.sort(np.argsort(-self.used[first:], kind="stable")[: self.limit // 2] + first)
        kept = np.concatenate((np.arange(first), kept))
        self.ids = gather(self.ids, (np.cumsum(self.sizes) - self.sizes)[kept], self.sizes[kept])
        self.sizes, self.used = self.sizes[kept], self.used[kept]
        self.known, self.shown = self.known.take(pa.array(kept)), self.shown.take(pa.array(kept))

    def _places(self, runs: pa.Array) -> np.ndarray:
        """Places of different runs in the table; what is unknown is learned."""
        if len(self.known) > self.limit:
            self._forget()
        self.turn += 1
        places = pc.fill_null(pc.index_in(runs, value_set=self.known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            places[missing] = len(self.known) + np.arange(len(missing))
            self._learn(runs.take(pa.array(missing)))
        self.used[places] = self.turn
        return places

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[bytes, str]]:
        """Little-endian 32-bit ids and decoded text of each text."""
        split = [self.runs(t) for t in texts]
        first = np.concatenate(([0], np.cumsum([len(runs) for runs in split]))).astype(np.int64)
        coded = pa.array([r for runs in split for r in runs], pa.large_string()).dictionary_encode()
        del split
        at = self._places(coded.dictionary)[coded.indices.to_numpy()]
        counts = self.sizes[at]
        ids = gather(self.ids, (np.cumsum(self.sizes) - self.sizes)[at], counts)
        bounds = np.concatenate(([0], np.cumsum(counts)))[first].tolist()
        shown = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first), self.shown.take(pa.array(at))), pa.scalar(" ", pa.large_string()))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield ids[a:b].tobytes(), shown[i].as_py()

    def decode(self, ids: bytes) -> str:
        """Tokens of little-endian 32-bit ids, joined by spaces: what the file's missing decoder means."""
        tokens = self.vocabulary.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_WORKER: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """The worker's own encoder: what one task loaded and learned serves the next."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


OUTPUTS = {"n_tokens": "long", "ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _encode(path: str, names: Sequence[str], outputs: Sequence[str]):
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}

    def result(name: str, ids: bytes, shown: str):
        if name == "n_tokens":
            return len(ids) // 4
        if name == "ids":
            return ids
        if name == "decoded":
            return shown
        return sha256(ids if name == "ids_sha256" else shown.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            at = 0
            while at < batch.num_rows:
                some, size, low = [], 0, at
                while at < batch.num_rows and (not some or size < SLICE):
                    some.append(texts[at].as_py() or "")
                    size += len(some[-1])
                    at += 1
                rows = [[result(n, ids, shown) for n in outputs] for ids, shown in encoder.encode(some)]
                columns = [pa.array([r[k] for r in rows], types[OUTPUTS[n]]) for k, n in enumerate(outputs)]
                kept = [batch.column(batch.schema.get_field_index(n)).slice(low, at - low) for n in names]
                yield pa.record_batch([*kept, *columns], names=[*names, *outputs])

    return run


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] = ("doc_id",),
           outputs: Sequence[str] = ("n_tokens", "ids")) -> DataFrame:
    """The ``keep`` columns with ``outputs``: ``n_tokens``, ``ids`` (little-endian 32-bit), ``decoded`` or digests of them.

    A null or empty text has no tokens. Every row is encoded by itself, whole; ``vocabulary`` must name a file that all
    executors have. Special tokens written in a text are taken as such. The kept columns must not carry an output's name.
    """
    keep, outputs = list(keep), list(outputs)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields]
    return rows.mapInArrow(_encode(vocabulary, keep, outputs), ", ".join([*fields, *[f"{n} {OUTPUTS[n]}" for n in outputs]]))
