"""Token files of directly addressable codes.

An id is cut into chunks of 8 bits, the lowest first. Level k holds the k-th chunk of every id that has one, a bitmap of
those whose id goes on, and a directory with the number of set bits before each block of 512. The place of an id on the
next level is the rank of its bit, so any token, or any range of tokens, is read without decoding what stands before it.

A file is a table of parts in ascending document order: ``part`` (partition, number), the ids and token ends of its
documents, and the coded ``payload``. Spark writes and reads the table, so it can lie in any store.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsloom.llm.text import gather

MAGIC = b"DAC1"
BLOCK = 512
PART_TOKENS = 1 << 19
END_ID = 2
CACHE = 600_000


def _directory(bits: np.ndarray) -> np.ndarray:
    sums = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
    return np.concatenate(([0], np.cumsum(sums)))[:-1] if len(sums) else sums


def dumps(ids: np.ndarray) -> bytes:
    """Coded form of unsigned 32-bit ids."""
    out, rest = [], ids.astype(np.uint32)
    levels = 0
    while levels == 0 or len(rest):
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        out.append(struct.pack("<q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bitmap.tobytes()
                   + _directory(more).astype("<i8").tobytes())
        rest = rest[more] >> 8
        levels += 1
    return MAGIC + struct.pack("<i", levels) + b"".join(out)


class Codes:
    """Random access to the ids of a payload."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a token payload")
        (count,), at = struct.unpack_from("<i", payload, 4), 8
        self.levels = []
        for _ in range(count):
            (n,) = struct.unpack_from("<q", payload, at)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bitmap = np.frombuffer(payload, np.uint8, (n + 7) // 8, at + 8 + n)
            directory = np.frombuffer(payload, "<i8", (n + BLOCK - 1) // BLOCK, at + 8 + n + len(bitmap))
            self.levels.append((chunks, bitmap, directory))
            at += 8 + n + len(bitmap) + 8 * len(directory)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(level, i: int) -> int:
        """Set bits before place ``i``."""
        chunks, bitmap, directory = level
        if i <= 0:
            return 0
        block = min(i // BLOCK, len(directory) - 1)
        low = block * BLOCK // 8
        whole, part = divmod(i, 8)
        found = int(directory[block]) + int(np.bitwise_count(bitmap[low:whole]).sum(dtype=np.int64))
        return found + (int(bitmap[whole] & ((1 << part) - 1)).bit_count() if part else 0)

    def __getitem__(self, i: int) -> int:
        value = shift = 0
        for level in self.levels:
            value |= int(level[0][i]) << shift
            if not level[1][i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range of places."""
        out = np.zeros(stop - start, dtype=np.uint32)
        where, low, high = None, start, stop
        for k, level in enumerate(self.levels):
            values = level[0][low:high].astype(np.uint32) << np.uint32(8 * k)
            if where is None:
                out[:] = values
            else:
                out[where] |= values
            first = low // 8
            bits = np.unpackbits(level[1][first: (high + 7) // 8], bitorder="little")[low - 8 * first: high - 8 * first]
            go = np.flatnonzero(bits)
            if not len(go):
                break
            where = go if where is None else where[go]
            low = self._rank(level, low)
            high = low + len(go)
        return out


#: White space of the splitter and of Python, as a class of Arrow's regular expressions.
_WHITE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Pieces that don't stand between lone spaces.
_LOOSE = rf"^$|^[{_WHITE}]|[{_WHITE}]$"
#: One line feed in the whole piece, alone between other characters.
_LONE_LINE = rf"^[^\n]*[^{_WHITE}]\n[^{_WHITE}][^\n]*$"
#: Marks behind a letter or digit: a word of their own. Other letters than these stay together with their marks.
_MARKS = ",.;:!?"
_MARKED = rf"[0-9A-Za-z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{24F}}][{_MARKS}]+$"


def _matches(strings: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False)


def _halves(strings: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Each string's first bytes, as many as ``sizes`` says, and its rest."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset: strings.offset + len(strings) + 1]
    cuts = np.empty(2 * len(strings) + 1, dtype=np.int64)
    cuts[::2] = offsets
    cuts[1::2] = offsets[:-1] + sizes
    both = pa.Array.from_buffers(pa.large_string(), 2 * len(strings), [None, pa.py_buffer(cuts), strings.buffers()[2]])
    even = np.arange(0, 2 * len(strings), 2)
    return both.take(pa.array(even)), both.take(pa.array(even + 1))


class Pieces:
    """Ids of texts by the library, asked once for each core of a piece between lone spaces.

    A space between two other characters starts a new word of the byte-level splitter, whatever stands around it, so the
    pieces (each with its space) can be encoded apart. So does a lone line feed, a word of its own, and so do marks at the
    end of a piece behind a letter or digit: what is left is the core. Runs of white space stay inside a piece. The library
    gets the unknown cores as texts of many cores: as a core holds no other space or line feed, the tokens that begin with
    one cut its answer. Known cores are a table of Arrow strings with their ids in one array; beyond the bound, the half
    that was used last stays.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        openers = tuple(self.library.pre_tokenizer.pre_tokenize_str(x)[0][0] for x in " \n")
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith(openers) for i in range(size)])
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Cores that the library gets alone: with special tokens or inner line feeds.
        self.alone = "|".join([r"(?s)^.+\n", *["".join(rf"\x{{{ord(c):X}}}" for c in s) for s in special]])
        self.lone = re.compile(r"(?<=\S) (?=\S)")
        self.limit = cache
        # The first core is empty.
        self.known = pa.array([""], pa.large_string())
        self.ids = np.zeros(0, dtype="<u4")
        self.sizes, self.used, self.turn = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), 0

    def _ask(self, texts: Sequence[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, cores: pa.Array) -> pa.Array:
        """Add different unknown cores to the table; they are returned in the table's order."""
        alone = _matches(cores, self.alone)
        cores = pa.concat_arrays([cores.filter(pa.array(~alone)), cores.filter(pa.array(alone))])
        texts = [c if c[0] == "\n" else " " + c for c in cores.to_numpy(zero_copy_only=False)]
        many = len(texts) - int(alone.sum())
        ids, sizes = [], []
        for at in range(0, many, 512):
            ids.append(np.frombuffer(self._ask(["".join(texts[at:min(at + 512, many)])])[0], dtype="<u4"))
            sizes.append(np.diff(np.flatnonzero(self.opens[ids[-1]]), append=len(ids[-1])))
        for packed in self._ask(texts[many:]):
            ids.append(np.frombuffer(packed, dtype="<u4"))
            sizes.append([len(ids[-1])])
        self.known = pa.concat_arrays([self.known, cores])
        self.ids = np.concatenate([self.ids, *ids])
        self.sizes = np.concatenate([self.sizes, *sizes])
        self.used = np.concatenate([self.used, np.zeros(len(cores), dtype=np.int64)])
        if len(self.sizes) != len(self.known):
            raise ValueError("the library's words don't begin where the cores do")
        return cores

    def _forget(self) -> None:
        """Keep the half of the table that was used last, and the empty core."""
        kept = np.sort(np.argsort(-self.used[1:], kind="stable")[: self.limit // 2] + 1)
        kept = np.concatenate(([0], kept))
        self.ids = gather(self.ids, (np.cumsum(self.sizes) - self.sizes)[kept], self.sizes[kept])
        self.known, self.sizes, self.used = self.known.take(pa.array(kept)), self.sizes[kept], self.used[kept]

    def _places(self, cores: pa.Array) -> np.ndarray:
        """Places of the cores in the table; what is unknown is learned."""
        if len(self.known) > self.limit:
            self._forget()
        self.turn += 1
        places = pc.fill_null(pc.index_in(cores, value_set=self.known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            before, unknown = len(self.known), cores.take(pa.array(missing))
            places[missing] = before + pc.index_in(unknown, value_set=self._learn(pc.unique(unknown))).to_numpy()
        self.used[places] = self.turn
        return places

    def _spell(self, pieces: pa.Array, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces behind a lone space, one after another, and how many each has; skipped pieces have none."""
        lines = _matches(pieces, _LONE_LINE) & ~skipped
        whole = pc.binary_length(pieces).to_numpy()
        left, right = _halves(pieces, np.where(skipped, 0, np.where(lines, pc.find_substring(pieces, "\n").to_numpy(), whole)))
        rows, n = np.flatnonzero(lines), len(pieces)
        parts = pa.concat_arrays([left, right.take(pa.array(rows))])
        cores, marks = _halves(parts, np.where(_matches(parts, _MARKED), pc.binary_length(pc.utf8_rtrim(parts, _MARKS)).to_numpy(),
                                               pc.binary_length(parts).to_numpy()))
        places, marks = self._places(cores), marks.dictionary_encode()
        asked = self._ask(marks.dictionary.to_pylist())
        behind = len(self.known) + marks.indices.to_numpy().astype(np.int64)
        sizes = np.concatenate([self.sizes, [len(x) // 4 for x in asked]]).astype(np.int64)
        # Core and marks of what stands before a line feed, then of what stands behind it.
        units = np.zeros((n, 4), dtype=np.int64)
        units[:, 0], units[:, 1] = places[:n], behind[:n]
        units[rows, 2], units[rows, 3] = places[n:], behind[n:]
        values = np.concatenate([self.ids, np.frombuffer(b"".join(asked), dtype="<u4")])
        counts = sizes[units]
        return gather(values, (np.cumsum(sizes) - sizes)[units].ravel(), counts.ravel()), counts.sum(axis=1)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text.

        The pieces of all texts are numbered by Arrow, each different piece is spelled once, and numpy gathers the ids of
        all pieces.
        """
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        which, different = np.asarray(coded.indices), coded.dictionary
        loose = _matches(different, _LOOSE)
        values, sizes = self._spell(different, loose)
        # The first piece has no space before it.
        begins = which[first[:-1]]
        heads = self._ask(different.take(pa.array(begins)).to_pylist())
        values = np.concatenate([values, np.frombuffer(b"".join(heads), dtype="<u4")])
        sizes = np.concatenate([sizes, [len(x) // 4 for x in heads]]).astype(np.int64)
        unit = which.astype(np.int64)
        unit[first[:-1]] = len(different) + np.arange(len(heads))
        counts = sizes[unit]
        ends = np.cumsum(counts)
        ids = gather(values, (np.cumsum(sizes) - sizes)[unit], counts)
        bounds = np.concatenate(([0], ends[first[1:] - 1]))
        # Texts with runs of white space, or white space at an end, are cut at lone spaces only.
        bad = np.concatenate([loose, loose[begins]])[unit]
        wide = np.flatnonzero(np.logical_or.reduceat(bad, first[:-1])).tolist()
        found = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        for i, packed in zip(wide, self._wide([texts[i] for i in wide])):
            found[i] = packed
        return found

    def _wide(self, texts: Sequence[str]) -> list[bytes]:
        if not texts:
            return []
        cut = [self.lone.split(t) for t in texts]
        extra = dict(zip(again := sorted({p for pieces in cut for p in pieces[1:-1]}), self._pieces(again)))
        tails = iter(self._ask([" " + pieces[-1] for pieces in cut if len(pieces) > 1]))
        heads = self._ask([pieces[0] for pieces in cut])
        return [head + b"".join(map(extra.__getitem__, pieces[1:-1])) + (next(tails) if len(pieces) > 1 else b"")
                for head, pieces in zip(heads, cut)]

    def _pieces(self, pieces: Sequence[str]) -> list[bytes]:
        if not pieces:
            return []
        strings = pa.array(pieces, pa.large_string())
        spaced = _matches(strings, " ") | _matches(strings, _LOOSE)
        values, sizes = self._spell(strings, spaced)
        ends = np.cumsum(sizes)
        found = [values[b - n:b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist())]
        rest = np.flatnonzero(spaced).tolist()
        for i, packed in zip(rest, self._ask([" " + pieces[i] for i in rest])):
            found[i] = packed
        return found


_WORKER: dict[str, Pieces] = {}


def worker_pieces(path: str) -> Pieces:
    """The worker's own pieces: what one task learned serves the next."""
    if path not in _WORKER:
        _WORKER[path] = Pieces(path)
    return _WORKER[path]


PARTS = "partition int, number int, docs array<bigint>, ends array<bigint>, payload binary"


def _code(path: str, end_id: int, part_tokens: int):
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["partition", "number", "docs", "ends", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, partition, number = worker_pieces(path), TaskContext.get().partitionId(), 0
        docs, ids, ends = [], [], [0]

        def part() -> pa.RecordBatch:
            payload = dumps(np.frombuffer(b"".join(ids), dtype="<u4"))
            return pa.record_batch([pa.array([partition], pa.int32()), pa.array([number], pa.int32()),
                                    pa.array([docs], pa.list_(pa.int64())), pa.array([ends[1:]], pa.list_(pa.int64())),
                                    pa.array([payload], pa.binary())], names=names)

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                some, size, low = [], 0, at
                while at < batch.num_rows and (not some or size < 8 << 20):
                    some.append(texts[at].as_py() or "")
                    size += len(some[-1])
                    at += 1
                for i, found in enumerate(pieces.encode(some)):
                    docs.append(keys[low + i].as_py())
                    ids.append(found + end)
                    ends.append(ends[-1] + len(found) // 4 + 1)
                    if ends[-1] >= part_tokens:
                        yield part()
                        number += 1
                        docs, ids, ends = [], [], [0]
        if docs:
            yield part()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
                 part_tokens: int = PART_TOKENS) -> None:
    """Write the token file of all documents, in ascending order of ``key``, nulls first.

    A null or empty text has the end id alone. Equal keys are ordered by a hash of their text; repeated rows are documents
    of their own. An empty table gives a file without parts. ``vocabulary`` must name a file that all executors have.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("_text")
    ordered = rows.repartitionByRange(parts, "_key", tie).sortWithinPartitions("_key", tie)
    ordered.mapInArrow(_code(vocabulary, end_id, part_tokens), PARTS).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            codes = Codes(batch.column(4)[row].as_py())
            docs, ends = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
            starts = [0, *ends[:-1]]
            ids = [codes.read(a, b).astype("<u4").tobytes() for a, b in zip(starts, ends)]
            n = len(docs)
            yield pa.record_batch([pa.array([batch.column(0)[row].as_py()] * n, pa.int32()),
                                   pa.array([batch.column(1)[row].as_py()] * n, pa.int32()),
                                   pa.array(docs, pa.int64()), pa.array(starts, pa.int64()),
                                   pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
                                   pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                  names=["partition", "number", "doc_id", "in_part", "n_tokens", "ids_crc32", "ids"])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start`` (ids before it in the file), ``n_tokens``, ``ids_crc32`` and ``ids`` of every document of a file."""
    parts = spark.read.schema(PARTS).parquet(path)
    rows = parts.mapInArrow(_read, "partition int, number int, doc_id long, in_part long, n_tokens long, ids_crc32 long, ids binary")
    if not with_ids:
        rows = rows.drop("ids")
    # One row per part, in file order.
    earlier = Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("partition", "number", F.element_at("ends", -1).alias("_n")).select(
        "partition", "number", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = rows.join(offsets, ["partition", "number"])
    return joined.withColumn("start", F.col("_before") + F.col("in_part")).drop("partition", "number", "_before", "in_part")
