"""Streams with keyed state that ends: windows and sessions with a side output for late rows, limiters by event time.

State lives in Spark's state store (RocksDB), by shards of keys. A shard has an event-time timer for the entry that ends first: when
the watermark passes it, every entry that is over is emitted once and removed, so state holds only what may still change. A batch
writes the state of the shards it touches; ``shards`` is to be chosen so that one shard's state fits a task. Rows that the watermark has
overtaken aren't dropped silently: they come out as rows of kind ``late``. Rows without a time come out as ``untimed``.

A row without an id is a heartbeat: its time advances the watermark and it is nothing else. One far enough in the future ends
all state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsloom.functions.timeutil import micros
from opsloom.operators.limits import Fold
from opsloom.session import work_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a row is: it has an id and a time, an id alone, or no id.
TIMED, UNTIMED, HEARTBEAT = 0, 1, 2
#: Groups of keys whose state is stored together; rows of a shard, as those of a key, are one task's.
SHARDS = 1_024


class _Shard(StatefulProcessor):
    """Rows of one shard of keys as columns, so that calls to the state store are per shard, batch and timer, not per key or row.

    Its state is a table (Arrow) and one timer, that of what ends first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "rows binary")
        self.timer = handle.getValueState("timer", "ms bigint")
        self.open_state()

    def close(self) -> None:
        pass

    def open_state(self) -> None:
        pass

    def known(self) -> pd.DataFrame | None:
        return _unpacked(self.kept.get()[0]) if self.kept.exists() else None

    def keep(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.kept.update((_packed(rows),))
        else:
            self.kept.clear()

    def wake(self, due: int | None) -> None:
        """The shard's timer is at ``due`` (ms), or not set."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before == due:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()  # an expired timer is removed by Spark
        yield from self.expire(timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def expire(self, timerValues, at: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError


class _Keyed(_Shard):
    """Times in microseconds and ids by key; what comes late or without a time is set apart."""

    columns: Sequence[str] = ()

    def overtaken(self, us: np.ndarray, mark_us: int) -> np.ndarray:
        raise NotImplementedError

    def take(self, rows: pd.DataFrame) -> None:
        """``rows``: key, us, id; all of a batch's rows that count."""
        raise NotImplementedError

    def frame(self, keys: Any, kind: str, **found: Any) -> pd.DataFrame:
        out = {"key": keys, "kind": kind} | {c: pd.array(found[c] if c in found else [None] * len(keys), dtype="boolean" if c == "allowed" else "Int64")
                                             for c in self.columns}
        return pd.DataFrame(out, columns=["key", "kind", *self.columns])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        taken = []
        for pdf in rows:
            untimed = pdf[pdf["state"] == UNTIMED]
            if len(untimed):
                yield self.frame(untimed["key"].to_numpy(), "untimed", row_id=untimed["id"].to_numpy())
            timed = pdf.loc[pdf["state"] == TIMED, ["key", "us", "id"]]
            late = self.overtaken(timed["us"].to_numpy(), mark)
            if late.any():
                yield self.frame(timed["key"].to_numpy()[late], "late", row_id=timed["id"].to_numpy()[late])
            taken.append(timed[~late])
        if any(map(len, taken)):
            self.take(pd.concat(taken, ignore_index=True))


class _Windows(_Keyed):
    """Counts per aligned window; a window ends when the watermark passes its end."""

    columns = ("start_us", "end_us", "n", "row_id")

    def __init__(self, size_us: int) -> None:
        self.size = size_us

    def overtaken(self, us, mark_us):
        return us - us % self.size + self.size <= mark_us

    def take(self, rows):
        us = rows["us"].to_numpy()
        counts = pd.DataFrame({"key": rows["key"], "start": us - us % self.size, "n": 1})
        counts = _joined(self.known(), counts).groupby(["key", "start"], dropna=False, as_index=False, sort=False)["n"].sum()
        self.keep(counts)
        self.wake((int(counts["start"].min()) + self.size) // 1000)

    def expire(self, timerValues, at):
        mark = max(at, timerValues.getCurrentWatermarkInMs())
        known = self.known()
        ends = known["start"].to_numpy() + self.size
        over = ends // 1000 <= mark
        self.keep(known[~over])
        self.wake(int(ends[~over].min()) // 1000 if not over.all() else None)
        done = known[over]
        yield self.frame(done["key"].to_numpy(), "window", start_us=done["start"].to_numpy(), end_us=ends[over], n=done["n"].to_numpy())


class _Sessions(_Keyed):
    """Sessions by silence. One stays until no row that is still accepted can touch it: its last row and two gaps."""

    columns = ("start_us", "end_us", "n", "row_id")

    def __init__(self, gap_us: int) -> None:
        self.gap = gap_us

    def overtaken(self, us, mark_us):
        return us + self.gap <= mark_us

    def _due(self, last: np.ndarray) -> np.ndarray:
        return -(-(last + 2 * self.gap) // 1000)

    def take(self, rows):
        us = rows["us"].to_numpy()
        spans = _joined(self.known(), pd.DataFrame({"key": rows["key"], "start": us, "last": us, "n": 1}))
        spans, code = _by_key(spans, "start", "last")
        # The end so far, per key: what begins a gap behind it opens a session.
        end = spans["last"].groupby(code).cummax().to_numpy()
        opens = np.ones(len(spans), dtype=bool)
        opens[1:] = (code[1:] != code[:-1]) | (spans["start"].to_numpy()[1:] - end[:-1] >= self.gap)
        first = np.flatnonzero(opens)
        merged = pd.DataFrame({"key": spans["key"].to_numpy()[first], "start": spans["start"].to_numpy()[first],
                               "last": end[np.append(first[1:], len(spans)) - 1], "n": np.add.reduceat(spans["n"].to_numpy(), first)})
        self.keep(merged)
        self.wake(int(self._due(merged["last"].to_numpy()).min()))

    def expire(self, timerValues, at):
        mark = max(at, timerValues.getCurrentWatermarkInMs())
        known = self.known()
        due = self._due(known["last"].to_numpy())
        over = due <= mark
        self.keep(known[~over])
        self.wake(int(due[~over].min()) if not over.all() else None)
        done = known[over]
        if len(done):
            yield self.frame(done["key"].to_numpy(), "session", start_us=done["start"].to_numpy(), end_us=done["last"].to_numpy() + self.gap, n=done["n"].to_numpy())


class _Limiter(_Keyed):
    """Requests wait until the watermark passes them, and are then decided in time order.

    What waits is appended batch by batch; ``kept`` has the limiters: a key's state, and when it is as good as new (``over``).
    """

    columns = ("us", "row_id", "allowed")

    def __init__(self, fold: Fold, reset_us: int) -> None:
        self.fold, self.reset = fold, reset_us

    def open_state(self) -> None:
        self.waiting = self.handle.getListState("waiting", "rows binary")

    def overtaken(self, us, mark_us):
        return -(-us // 1000) * 1000 <= mark_us

    def take(self, rows):
        self.waiting.appendValue((_packed(rows),))
        due = int(-(-rows["us"].min() // 1000))
        self.wake(min(due, self.timer.get()[0]) if self.timer.exists() else due)

    def expire(self, timerValues, at):
        mark = max(at, timerValues.getCurrentWatermarkInMs()) * 1000
        parts = [_unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        known = self.known()
        before = {k: (over, state) for k, over, state in zip(known["key"], known["over"].tolist(), known["state"])} if known is not None else {}
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"key": [], "us": [], "id": []}).astype({"key": object, "us": "int64", "id": "int64"})
        ready = -(-rows["us"].to_numpy() // 1000) * 1000 <= mark
        left = rows[~ready]
        done, code = _by_key(rows[ready], "us", "id")
        us, keys = done["us"].to_numpy(), done["key"].to_numpy()
        allowed = np.empty(len(done), dtype=bool)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        for low, high in zip(first.tolist(), [*first[1:].tolist(), len(done)]):
            held = before.get(keys[low])
            allowed[low:high], after = self.fold(us[low:high], np.empty((high - low, 0)), None if held is None else [int(x) for x in held[1]])
            before[keys[low]] = (int(us[high - 1]) + self.reset, [int(x) for x in after])
        # Silent for so long that the limiter is as good as new: its state ends, unless requests of its key wait.
        busy = set(left["key"].tolist())
        stay = {k: v for k, v in before.items() if v[0] > mark or k in busy}
        self.keep(pd.DataFrame({"key": pd.Series(list(stay), dtype=object), "over": pd.Series([v[0] for v in stay.values()], dtype="int64"),
                                "state": pd.Series([v[1] for v in stay.values()], dtype=object)}))
        if not len(left):
            self.waiting.clear()
        elif ready.any():
            self.waiting.put([(_packed(left),)])
        due = [int(left["us"].min())] if len(left) else []
        due += [v[0] for k, v in stay.items() if k not in busy]
        self.wake(-(-min(due) // 1000) if due else None)
        if len(done):
            yield self.frame(keys, "decided", us=us, row_id=done["id"].to_numpy(), allowed=allowed)


class _Buffers(_Shard):
    """Bodies of a key wait until they reach ``max_bytes`` or the first one has waited for ``max_us``.

    ``kept`` has what waits, key by key in order of delivery; ``numbers`` the objects that each key has had.
    """

    def __init__(self, max_bytes: int, max_us: int, by_event: bool) -> None:
        self.max_bytes, self.max_us, self.by_event = max_bytes, max_us, by_event

    def open_state(self) -> None:
        self.numbers = self.handle.getValueState("numbers", "rows binary")

    def _due(self, held: list[tuple]) -> int:
        return -(-(held[0][0] + self.max_us) // 1000)

    def _open(self) -> tuple[dict, dict]:
        known = self.known()
        buffers: dict = {}
        if known is not None:
            for k, *row in zip(known["key"], *(known[c].tolist() for c in ("us", "id", "size", "body"))):
                buffers.setdefault(k, []).append(tuple(row))
        counted = _unpacked(self.numbers.get()[0]) if self.numbers.exists() else None
        return buffers, dict(zip(counted["key"], counted["n"].tolist())) if counted is not None else {}

    def _store(self, buffers: dict, numbers: dict | None) -> None:
        flat = [(k, *row) for k, held in buffers.items() for row in held]
        self.keep(pd.DataFrame(flat, columns=["key", "us", "id", "size", "body"]))
        if numbers is not None:
            self.numbers.update((_packed(pd.DataFrame({"key": pd.Series(list(numbers), dtype=object), "n": list(numbers.values())})),))
        self.wake(min(map(self._due, buffers.values())) if buffers else None)

    def _objects(self, flushed: list[tuple], numbers: dict) -> pd.DataFrame:
        rows = []
        for key, held, reason in flushed:
            n = numbers.get(key, 0)
            numbers[key] = n + 1
            rows.append((key, n, reason, len(held), sum(h[2] for h in held), held[0][0], held[-1][0], "\n".join(h[3] for h in held)))
        return pd.DataFrame(rows, columns=["key", "flush", "reason", "n", "bytes", "start_us", "end_us", "body"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = None if self.by_event else timerValues.getCurrentProcessingTimeInMs() * 1000
        new: dict = {}
        for pdf in rows:
            pdf = pdf[pdf["state"] == TIMED] if self.by_event else pdf[pdf["state"] != HEARTBEAT]
            times = pdf["us"].tolist() if self.by_event else [now] * len(pdf)
            for k, *row in zip(pdf["key"], times, pdf["id"].tolist(), pdf["size"].tolist(), pdf["body"]):
                new.setdefault(k, []).append(tuple(row))
        if not new:
            return
        buffers, numbers = self._open()
        flushed = []
        for k, added in new.items():
            held = buffers.pop(k, [])
            size = sum(h[2] for h in held)
            for row in sorted(added):
                if held and row[0] >= held[0][0] + self.max_us:
                    flushed.append((k, held, "time"))
                    held, size = [], 0
                held.append(row)
                size += row[2]
                if size >= self.max_bytes:
                    flushed.append((k, held, "size"))
                    held, size = [], 0
            if held:
                buffers[k] = held
        if flushed:
            yield self._objects(flushed, numbers)
        self._store(buffers, numbers if flushed else None)

    def expire(self, timerValues, at):
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        buffers, numbers = self._open()
        # As timers do, a buffer ends when the time has passed it; the one whose timer this is has ended.
        over = [k for k, held in buffers.items() if self._due(held) < now or self._due(held) <= at]
        flushed = [(k, buffers.pop(k), "time") for k in over]
        if flushed:
            yield self._objects(flushed, numbers)
        self._store(buffers, numbers if flushed else None)


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(packed)).read_all().to_pandas()


def _joined(known: pd.DataFrame | None, more: pd.DataFrame) -> pd.DataFrame:
    return more if known is None else pd.concat([known, more], ignore_index=True)


def _by_key(rows: pd.DataFrame, *order: str) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows sorted by key and ``order``, and the keys' numbers."""
    code, _ = pd.factorize(rows["key"], use_na_sentinel=False)
    place = np.lexsort((*(rows[c].to_numpy() for c in reversed(order)), code))
    return rows.iloc[place].reset_index(drop=True), code[place]


def _sharded(timed: DataFrame, key: str, row_id: str, us: Column, shards: int, *more: Column) -> tuple[DataFrame, Column]:
    """Rows ``shard, key, id, us, state`` without nulls but in ``key``, which is text; and the key of a result in its own type.

    Spark drops no late row, as the watermark's column is no part of these.
    """
    kind = timed.schema[key].dataType
    value, name = F.col(key), kind.typeName()
    if name in ("float", "double"):
        value = value + F.lit(0).cast(kind)  # the zeros are one key
    if name in ("array", "struct", "variant"):
        exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
        text = F.when(value.isNotNull(), F.to_json(F.struct(value.alias("k")), exact))
        back = F.from_json("key", f"k {kind.simpleString()}", exact)["k"]
    elif name == "binary":
        text, back = F.hex(value), F.unhex("key")
    else:
        text, back = value.cast("string"), F.col("key").cast(kind)
    state = F.when(F.col(row_id).isNull(), HEARTBEAT).when(us.isNull(), UNTIMED).otherwise(TIMED)
    return timed.select(F.pmod(F.xxhash64(text), F.lit(shards)).cast("int").alias("shard"), text.alias("key"),
                        F.coalesce(F.col(row_id).cast("bigint"), F.lit(0).cast("bigint")).alias("id"),
                        F.coalesce(us, F.lit(0).cast("bigint")).alias("us"), state.alias("state"), *more), back.alias(key)


def _keyed(stream: DataFrame, ts: str, key: str, row_id: str, delay: str, shards: int, processor: StatefulProcessor, columns: str) -> DataFrame:
    timed = stream.withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", delay)
    rows, back = _sharded(timed, key, row_id, F.unix_micros("_time") + 0, shards)
    found = rows.groupBy("shard").transformWithStateInPandas(processor, f"key string, kind string, {columns}", "Append", "EventTime")
    return found.select(back, *found.columns[1:])


def _slot_times(df: DataFrame, key: str, row_id: str) -> DataFrame:
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return df.select(F.col(key), "kind", at("start_us").alias("start"), at("end_us").alias("end"), "n", F.col("row_id").alias(row_id))


def windows_and_late(stream: DataFrame, ts: str, seconds: float, key: str, row_id: str, delay: str, shards: int = SHARDS) -> DataFrame:
    """Aligned windows per key, each emitted once when the watermark passes its end; rows of a window that is over are ``late``."""
    columns = "start_us bigint, end_us bigint, n bigint, row_id bigint"
    return _slot_times(_keyed(stream, ts, key, row_id, delay, shards, _Windows(int(seconds * 1_000_000)), columns), key, row_id)


def sessions_and_late(stream: DataFrame, ts: str, gap_seconds: float, key: str, row_id: str, delay: str, shards: int = SHARDS) -> DataFrame:
    """Sessions per key, each emitted once; a row is ``late`` if the watermark has passed it by the gap."""
    columns = "start_us bigint, end_us bigint, n bigint, row_id bigint"
    return _slot_times(_keyed(stream, ts, key, row_id, delay, shards, _Sessions(int(gap_seconds * 1_000_000)), columns), key, row_id)


def limiter_by_time(stream: DataFrame, ts: str, key: str, row_id: str, fold: Fold, reset_seconds: float, delay: str,
                    shards: int = SHARDS) -> DataFrame:
    """Decisions of a limiter in event-time order, whatever the order of arrival: ``allowed`` of each request, null if ``late``.

    After ``reset_seconds`` of silence the limiter is as good as new, and the key's state ends. A key's waiting requests are those of the watermark's delay; its decisions depend on one another, so they are one task's.
    """
    found = _keyed(stream, ts, key, row_id, delay, shards, _Limiter(fold, int(reset_seconds * 1_000_000)), "us bigint, row_id bigint, allowed boolean")
    return found.select(F.col(key), "kind", F.col("row_id").alias(row_id), "allowed")


def buffered_delivery(stream: DataFrame, key: str, row_id: str, body: Column, max_bytes: int, max_seconds: float,
                      ts: str | None = None, delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """One row per delivered object: bodies of a key, one a line, flushed at ``max_bytes`` or ``max_seconds`` after the first one.

    ``flush`` numbers a key's objects, ``reason`` is ``size`` or ``time``; ``bytes`` are those of the bodies. A null body is empty.
    With ``ts`` waiting is measured in event time (rows without a time, and heartbeats without an id, are not delivered; a row
    that comes behind its key's open buffer joins it); without it by the clock, and the sink must keep triggering.
    A buffer holds less than ``max_bytes`` and one body. Rows of a key are one task's: give hot keys a shard in ``key``.
    """
    text = F.coalesce(body.cast("string"), F.lit(""))
    at = F.lit(None).cast("bigint") if ts is None else F.unix_micros("_time") + 0
    timed = stream if ts is None else stream.withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", delay)
    rows, back = _sharded(timed, key, row_id, at, shards, F.octet_length(text).cast("bigint").alias("size"), text.alias("body"))
    columns = "flush bigint, reason string, n bigint, bytes bigint, start_us bigint, end_us bigint, body string"
    processor = _Buffers(max_bytes, int(max_seconds * 1_000_000), ts is not None)
    found = rows.groupBy("shard").transformWithStateInPandas(processor, f"key string, {columns}", "Append", "ProcessingTime" if ts is None else "EventTime")
    return found.select(back, *found.columns[1:])


def run_arrivals(spark: SparkSession, arrivals: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], label: str,
                state_rows: list[int] | None = None) -> DataFrame:
    """Run a stream while files arrive: one micro-batch (and restart from the checkpoint) per frame of ``arrivals``.

    The sink's folders are named by the batch, so a repeated batch replaces itself. ``state_rows`` gets the number of state
    entries after each arrival.
    """
    inbox, out, checkpoint = (work_path(spark, f"{label}-{part}") for part in ("inbox", "out", "checkpoint"))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        for frame in arrivals:
            frame.write.mode("append").parquet(inbox)
            result = build(spark.readStream.schema(frame.schema).parquet(inbox))
            query = (result.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint)
                     .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start())
            query.awaitTermination()
            if state_rows is not None:
                state_rows.append(sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]))
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(result.schema).option("basePath", out).parquet(f"{out}/batch=*").select(*result.columns)


def heartbeat(like: DataFrame, ts: str, seconds: float) -> DataFrame:
    """One row with nothing but a time, ``seconds`` after the last one of ``like``."""
    top = like.agg(F.max(micros(ts)).alias("_top"))
    at = F.timestamp_micros(F.col("_top") + int(seconds * 1_000_000)).cast(like.schema[ts].dataType)
    return top.select(*[(at if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema.fields])
