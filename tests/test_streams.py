"""Streams: equal to the batch form, late rows, state across micro-batches, repeated batches."""

import datetime
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from opsloom.operators import limits
from opsloom.operators.ranking import latest_by
from opsloom.session import work_path
from opsloom.sources.scan import read_stream
from opsloom.streaming import entries, log, runner, stateful, windows


def rows(df):
    return sorted(map(tuple, df.collect()))


def inbox(spark, df, files=4):
    path = work_path(spark, "inbox")
    for number, part in enumerate(df.randomSplit([1.0] * files, 3)):
        part.coalesce(1).write.parquet(f"{path}/f{number}")
    return path + "/*"


def test_windows_equal_batch(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    path = inbox(spark, events)
    stream = lambda: windows.with_event_time(read_stream(spark, path, events.schema, maxFilesPerTrigger="1"), "ts", "60 days")
    for build in (lambda d: windows.tumbling(d, "ts", "1 hour", ["event_type"]),
                  lambda d: windows.sliding(d, "ts", "2 hours", "1 hour"),
                  lambda d: windows.downsample(d.withColumn("value", F.col("value").cast("decimal(18,2)")), "ts", "value", "1 day", "avg")):
        keys = [c for c in build(events).columns if c in ("start", "end", "event_type")]
        assert rows(runner.run_updates(build(stream()), "equal", spark, keys)) == rows(build(events))


def test_late_rows_are_dropped(spark):
    """Lateness is judged by the watermark of the batch before, so a batch lies between."""
    path = work_path(spark, "late")
    for number, (row, hour, minute) in enumerate([(1, 12, 0), (2, 12, 1), (3, 9, 0), (4, 12, 2), (5, 23, 0)]):
        df = spark.createDataFrame([(row, datetime.datetime(2024, 1, 1, hour, minute))], "id int, ts timestamp_ntz")
        df.coalesce(1).write.parquet(f"{path}/f{number}")
    stream = windows.with_event_time(read_stream(spark, path + "/*", df.schema, maxFilesPerTrigger="1"), "ts", "10 minutes")
    out = runner.run_to_files(windows.tumbling(stream, "ts", "1 hour"), "late-out", spark)
    assert [(r["start"].hour, r["n"]) for r in out.orderBy("start").collect()] == [(12, 3)]


BASE = datetime.datetime(2024, 1, 1)
EVENTS = "k string, ts timestamp_ntz, id long"


def arrivals(spark, batches):
    """Micro-batches of (key, second, id); a second of None is a row without a time."""
    at = lambda s: None if s is None else BASE + datetime.timedelta(seconds=s)
    return [spark.createDataFrame([(k, at(s), i) for k, s, i in rows], EVENTS) for rows in batches]


def test_limiter_decides_in_event_time_order(spark):
    """Requests arrive in any order; the decisions are those of one pass in time order, and no state stays."""
    rng = random.Random(3)
    made = [(rng.choice(["a", "a", None, "c"]), s, s) for s in range(0, 300)]
    late_by = {i: rng.randrange(3) for _, _, i in made}
    batches = [[r for r in made if r[1] // 100 + late_by[r[2]] == n] for n in range(5)] + [[(None, 10_000, None)]]
    for b in batches:
        rng.shuffle(b)
    left = []
    build = lambda s: stateful.limiter_by_time(s, "ts", "k", "id", limits.anchored_fold(2, 20_000_000), 20, "300 seconds")
    out = stateful.run_arrivals(spark, arrivals(spark, batches), build, "limits", left)
    got = {r["id"]: (r["kind"], r["allowed"]) for r in out.collect()}
    want = {}
    for key in {k for k, _, _ in made}:
        mine = sorted((s * 1_000_000, i) for k, s, i in made if k == key)
        flags, _ = limits.anchored_fold(2, 20_000_000)(np.array([m[0] for m in mine]), None, None)
        want |= {i: ("decided", bool(f)) for (_, i), f in zip(mine, flags)}
    assert got == want
    assert left[0] > 0 and left[-1] == 0


def test_late_rows_come_out_and_state_ends(spark):
    batches = [[("a", 10, 1), ("a", 70, 2), (None, 15, 3)], [("a", 130, 4), ("a", 20, 5)], [("a", 30, 6), ("b", None, 7), (None, 200, 8)], [(None, 9_000, None)]]
    left = []
    build = lambda s: stateful.windows_and_late(s, "ts", 60, "k", "id", "60 seconds")
    out = stateful.run_arrivals(spark, arrivals(spark, batches), build, "late", left).collect()
    windows_ = sorted((str(r["k"]), (r["start"] - BASE).seconds, r["n"]) for r in out if r["kind"] == "window")
    # After the second batch the watermark is 70 s: row 6 is late, row 5 came in time.
    assert windows_ == [("None", 0, 1), ("None", 180, 1), ("a", 0, 2), ("a", 60, 1), ("a", 120, 1)]
    assert [(r["kind"], r["id"]) for r in out if r["kind"] != "window"] in ([("late", 6), ("untimed", 7)], [("untimed", 7), ("late", 6)])
    assert left[-1] == 0


def test_sessions_merge_across_batches(spark):
    rng = random.Random(5)
    made = [(rng.choice("ab"), rng.randrange(0, 900), i) for i in range(120)]
    batches = [[r for r in made if r[1] // 300 + (r[2] % 4 == 0) == n] for n in range(4)] + [[(None, 50_000, None)]]
    left = []
    out = stateful.run_arrivals(spark, arrivals(spark, batches), lambda s: stateful.sessions_and_late(s, "ts", 12, "k", "id", "400 seconds"), "sessions", left)
    got = sorted((r["k"], (r["start"] - BASE).seconds, (r["end"] - BASE).seconds, r["n"]) for r in out.collect())
    want = []
    for key in "ab":
        for s in sorted(s for k, s, _ in made if k == key):
            if want and want[-1][0] == key and s - (want[-1][2] - 12) < 12:
                want[-1] = (key, want[-1][1], s + 12, want[-1][3] + 1)
            else:
                want.append((key, s, s + 12, 1))
    assert got == sorted(want) and left[-1] == 0


def test_repeated_batch_changes_nothing(spark):
    path = work_path(spark, "upsert")
    sink = runner.upsert_latest(path, "k", "v", spark)
    first = spark.createDataFrame([(1, 1), (2, 5)], "k int, v int")
    second = spark.createDataFrame([(1, 3), (2, 4)], "k int, v int")
    sink(first, 0)
    sink(second, 1)
    sink(second, 1)
    assert rows(latest_by(spark.read.parquet(f"{path}/v*"), ["k"], ["v"])) == [(1, 3), (2, 5)]
    out = work_path(spark, "batches")
    write = runner.write_idempotent(out)
    write(first, 0)
    write(first, 0)
    assert spark.read.parquet(f"{out}/batch=0").count() == 2


def test_dead_letters_do_not_stop_good_rows(spark, data):
    lines = spark.createDataFrame([(1, '{"a": 1}'), (2, "{bad"), (3, '{"b": 2}'), (4, None)], "id int, body string")
    stream = read_stream(spark, inbox(spark, lines, 2), lines.schema)
    good, bad = log.good_and_bad(stream, "body", "a int", ["a"], ["id"])
    assert rows(runner.run_to_files(good, "good", spark)) == [(1, 1)]
    assert sorted(r["id"] for r in runner.run_to_files(bad, "bad", spark).collect()) == [2, 3, 4]


def test_stream_upsert_equals_batch(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").select("user_id", "event_id")
    path = work_path(spark, "latest")
    stream = read_stream(spark, inbox(spark, events, 3), events.schema, maxFilesPerTrigger="1")
    runner.run_to_batches(stream, "latest", spark, "append", runner.upsert_latest(path, "user_id", "event_id", spark))
    assert rows(latest_by(spark.read.parquet(f"{path}/v*"), ["user_id"], ["event_id"]).select("user_id", "event_id")) == rows(latest_by(events, ["user_id"], ["event_id"]))


def test_timed_delivery(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    out = work_path(spark, "timed")
    q = runner.deliver(runner.file_stream(spark, f"{data}/events.parquet"), out, work_path(spark, "timed-state"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(out).count() == events.count()


def test_buffers_flush_by_size_or_time(spark):
    """Objects equal one pass over each key's rows, however the rows are dealt to batches; nothing stays in the buffers."""
    rng = random.Random(8)
    made = sorted((s, rng.choice(["a", "a", None, "c"]), i, rng.choice(["", "x" * rng.randrange(9), None])) for i, s in enumerate(rng.sample(range(2000), 250)))
    at = lambda s: BASE + datetime.timedelta(seconds=s)
    for cuts in ([250], [10, 11, 130, 250]):
        frames, first = [], 0
        for cut in cuts:
            frames.append([(k, at(s), i, b) for s, k, i, b in made[first:cut]])
            first = cut
        frames = [spark.createDataFrame(f, EVENTS + ", body string") for f in [*frames, [(None, at(9000), None, None), ("a", None, 900, "untimed")]]]
        build = lambda s: stateful.buffered_delivery(s, "k", "id", F.col("body"), 20, 100, "ts")
        got = {(r["k"], r["flush"]): (r["reason"], r["n"], r["bytes"], r["body"]) for r in stateful.run_arrivals(spark, frames, build, "buffers").collect()}
        want = {}
        for key in ("a", None, "c"):
            held, number = [], 0
            for s, _, _, b in [m for m in made if m[1] == key] + [(9000, key, None, None)]:
                if held and s >= held[0][0] + 100:
                    want[key, number] = ("time", held)
                    held, number = [], number + 1
                held.append((s, b or ""))
                if sum(len(x) for _, x in held) >= 20:
                    want[key, number] = ("size", held)
                    held, number = [], number + 1
        assert got == {k: (why, len(h), sum(len(x) for _, x in h), "\n".join(x for _, x in h)) for k, (why, h) in want.items()}
        assert {why for why, _ in want.values()} == {"size", "time"}


def test_appended_ids_grow_and_repeats_change_nothing(spark, monkeypatch):
    """Clocks that stand still or go back, entries without a time, a null stream, an empty batch; marks are compacted on the way."""
    monkeypatch.setattr(entries.EntryLog, "FULL", 2)
    rng = random.Random(2)
    found = entries.EntryLog(spark, work_path(spark, "log"), "k", "ms", "id", chunk_ms=5, fan=2)
    batches = [[("a", 10, 1), ("a", 10, 2), (None, 7, 3)], [("a", 4, 4), ("a", 10, 5), ("a", 12, 6), ("b", None, 7)], [],
               [("a", None, 8), ("a", 12, 9), (None, 7, 10)], [(rng.choice("ab"), rng.randrange(30), i) for i in range(20, 80)]]
    last, seqs, want = {}, {}, {}
    for number, rows_ in enumerate(batches):
        df = spark.createDataFrame(rows_, "k string, ms long, id long")
        found.append(df, number)
        once = rows(found.read().select("id", "entry_id"))
        found.append(df, number)
        assert rows(found.read().select("id", "entry_id")) == once
        floor = dict(last)
        for k, ms, i in sorted(rows_, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            at = max(ms or 0, floor.get(k, 0))
            last[k] = max(at, last.get(k, 0))
            seqs[k, at] = seqs.get((k, at), -1) + 1
            want[i] = f"{at}-{seqs[k, at]}"
    assert dict(once) == want
    ids = found.between("a", "10-1", "12-1", 4).select("entry_id").collect()
    assert [r["entry_id"] for r in ids] == ["10-1", "10-2", "10-3", "12-0"]


class Shelf:
    """A shard's state and timers without Spark, with the number of calls."""

    class Value:
        def __init__(self, shelf):
            self.shelf, self.held = shelf, None

        def exists(self):
            self.shelf.calls += 1
            return bool(self.held)

        def get(self):
            self.shelf.calls += 1
            return self.held

        def update(self, held):
            self.shelf.calls += 1
            self.held = held

        def clear(self):
            self.update(None)

        def appendValue(self, row):
            self.update([*(self.held or []), row])

        put = update

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getValueState(self, name, schema):
        return self.Value(self)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def run(self, processor, batches, marks):
        """All rows that ``processor`` gives for the batches, each with the watermark (ms) it begins with."""
        processor.init(self)
        out = []
        for batch, mark in zip(batches, marks):
            times = type("Times", (), {"getCurrentWatermarkInMs": lambda _: mark})()  # noqa: B023
            out += processor.handleInputRows((0,), iter([batch] if len(batch) else []), times)
            for at in sorted(t for t in self.timers if t < mark):
                self.timers.discard(at)
                out += processor.handleExpiredTimer((0,), times, type("Info", (), {"getExpiryTimeInMs": lambda _: at})())  # noqa: B023
        return pd.concat(out, ignore_index=True)


def test_calls_to_the_state_do_not_grow_with_keys_and_sessions():
    """One timer and one stored table serve all keys of a shard."""
    calls = {}
    for keys in (3, 60):
        made = pd.DataFrame([(str(k), s * 1_000_000, k * 100 + s // 100, stateful.TIMED) for k in range(keys) for s in range(0, 4000, 100)],
                            columns=["key", "us", "id", "state"]).sample(frac=1, random_state=1)
        made["size"], made["body"] = 1, "x"
        batches, marks = [made[made["us"] < 2_000_000_000], made[made["us"] >= 2_000_000_000], made[:0]], [0, 1_000_000, 9_000_000]
        for name, processor, n in (("sessions", stateful._Sessions(60_000_000), 40), ("windows", stateful._Windows(200_000_000), 20),
                                   ("limiter", stateful._Limiter(limits.anchored_fold(1, 150_000_000), 150_000_000), 40),
                                   ("buffers", stateful._Buffers(3, 10_000_000_000, True), 13)):
            shelf = Shelf()
            found = shelf.run(processor, batches if name != "buffers" else [made, made[:0]], marks)
            assert len(found[found["reason"] == "size"] if name == "buffers" else found) == keys * n
            calls.setdefault(name, []).append(shelf.calls)
            assert len(shelf.timers) <= 1
    assert all(few == many for few, many in calls.values())


def test_keys_of_any_type_and_large_ids(spark):
    """Ids and keys beyond 2^53, null keys beside others in one shard, the two zeros, bytes that are no text."""
    big = 2 ** 53 + 1
    for kind, a, b in (("bigint", big, big + 1), ("double", 0.0, 0.1), ("binary", b"\xff\xfe", b""), ("struct<x:int,y:timestamp>", (1, BASE + datetime.timedelta(microseconds=7)), (None, BASE))):
        other = -0.0 if kind == "double" else a
        at = lambda s: BASE + datetime.timedelta(seconds=s)
        frames = [[(a, at(1), big), (None, at(2), big + 2), (b, None, big + 4)], [(other, at(3), big + 6), (None, at(9000), None)], [(None, at(9000), None)]]
        frames = [spark.createDataFrame(f, f"k {kind}, ts timestamp_ntz, id long") for f in frames]
        build = lambda s: stateful.limiter_by_time(s, "ts", "k", "id", limits.anchored_fold(1, 60_000_000), 60, "100 seconds", shards=1)
        out = stateful.run_arrivals(spark, frames, build, "kinds")
        assert out.schema["k"].dataType.simpleString() == kind
        got = {r["id"]: (r["kind"], r["allowed"], bytes(r["k"]) if kind == "binary" and r["k"] is not None else r["k"]) for r in out.collect()}
        plain = lambda k: None if k is None else tuple(k) if isinstance(k, tuple) else k
        assert {i: (kind_, allowed, plain(k)) for i, (kind_, allowed, k) in got.items()} == {
            big: ("decided", True, a), big + 2: ("decided", True, None), big + 4: ("untimed", None, b), big + 6: ("decided", False, a)}
