"""Streams equal their batch form, also when a message spans micro-batches."""

import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from seriesloom.plans.streams import rocksdb_state
from seriesloom.streaming import keyed_table, ordered, threads
from seriesloom.streaming.events import parse_events

SCHEMA = "thread_id string, seq long, message string, finish_reason string, agent string"
BATCHES = [
    [("a", 1, "He", None, "reporter"), ("b", 1, "x", None, "planner"), ("a", 2, "llo", None, "reporter"), ("", 3, "no thread", "stop", "x"), ("c", 1, "", "stop", "x")],
    [("a", 3, "!", "stop", "reporter"), ("a", 4, "again", None, "planner"), ("b", 2, "y", "interrupt", "planner")],
    [("a", 5, " done", "stop", "reporter"), ("b", 3, "open", None, "planner")],
]


def stream_of(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    import os
    import time

    now = time.time()
    for i in range(len(BATCHES)):
        for f in (folder / f"b{i}").iterdir():
            os.utime(f, (now - 100 + i, now - 100 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def whole(spark):
    return spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)


def test_stream_equals_batch(spark, tmp_path):
    stream = threads.assemble_stream(stream_of(spark, tmp_path))
    threads.write_finished(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    cols = ("thread_id", "first_seq", "last_seq", "n_chunks", "text", "finish_reason")
    got = rows(spark.read.parquet(str(tmp_path / "out")), *cols)
    assert got == [("a", 1, 3, 3, "Hello!", "stop"), ("a", 4, 5, 2, "again done", "stop"), ("b", 1, 2, 2, "xy", "interrupt")]
    assert got == rows(threads.assemble_batch(whole(spark)), *cols)


def test_upsert_keeps_newest(spark, tmp_path):
    query = threads.upsert_conversations(threads.assemble_stream(stream_of(spark, tmp_path)), str(tmp_path / "t"), str(tmp_path / "mark"))
    query.awaitTermination(120)
    assert rows(threads.latest_version(spark, str(tmp_path / "t")), "thread_id", "text") == [("a", "again done"), ("b", "xy")]


def test_report_text_falls_back(spark):
    assert rows(threads.report_text(whole(spark)), "thread_id", "text") == [("a", "Hello! done"), ("b", "xyopen")]


FRAGMENTS = [
    ("t", 3, 0, "id2", "other", '": 1}'), ("t", 1, 0, "", "find", '{"a'), ("t", 2, 0, "id1", "", None), ("t", 4, 1, None, None, "z"), ("t", 5, None, "id9", "loose", "{}"),
]


def test_fragments(spark, tmp_path):
    df = spark.createDataFrame(FRAGMENTS, "thread_id string, seq long, index int, id string, name string, args string")
    want = [("t", 0, "find", "id1", '{"a": 1}'), ("t", 0, "loose", "id9", "{}"), ("t", 1, "", "", "z")]
    assert rows(threads.merge_fragments(df), "thread_id", "index", "name", "id", "args") == want
    timed = df.selectExpr("*", "timestamp_seconds(seq) AS at")
    timed.coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "f"))

    def drain():
        threads.write_finished(threads.merge_fragments_stream(stream, "at", "10 seconds", "20 seconds"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
        return rows(spark.read.schema("thread_id string, index int, name string, id string, args string").parquet(str(tmp_path / "out")))

    assert drain() == []  # calls are open until the watermark has passed them
    later = spark.createDataFrame([("u", 500, 0, "id3", "later", "{"), ("u", 501, 0, "", "", "}"), ("t", 600, 0, "id4", "next", "n")], "thread_id string, seq long, index int, id string, name string, args string")
    later.selectExpr("*", "timestamp_seconds(seq) AS at").coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    got = drain()  # a fragment of the same index much later is a call of its own
    assert sorted(got) == sorted([*want, ("u", 0, "later", "id3", "{}")])
    assert drain() == got  # given once


def test_event_texts(spark):
    text = 'event: a\ndata: {"x": 1}\n\nevent: b\n\ndata: {"x": 2}\n\nevent: c\ndata: {bad\n\nevent: d\ndata: [DONE]\n\nevent: e\ndata: 7'
    got = rows(parse_events(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t"), "event_no", "type", "data")
    assert got == [(0, "a", '{"x": 1}'), (4, "done", None), (5, "e", "7")]


def test_late_chunks_take_their_place(spark, tmp_path, monkeypatch):
    late = [[("a", 2, "B", None, "r")], [("a", 1, "A", None, "r")], [("a", 3, "C", "stop", "r")]]
    monkeypatch.setitem(globals(), "BATCHES", late)
    stream = threads.assemble_stream(stream_of(spark, tmp_path))
    threads.write_finished(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "first_seq", "last_seq", "text") == [(1, 3, "ABC")]


def test_restart_without_new_data(spark, tmp_path):
    chunks = stream_of(spark, tmp_path)
    for _ in range(2):
        threads.upsert_conversations(threads.assemble_stream(chunks), str(tmp_path / "t"), str(tmp_path / "mark")).awaitTermination(120)
    assert rows(threads.latest_version(spark, str(tmp_path / "t")), "thread_id", "text") == [("a", "again done"), ("b", "xy")]


# ---- any order of arrival


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Listed:
    def __init__(self):
        self.v = []

    def exists(self):
        return bool(self.v)

    def get(self):
        return iter(self.v)

    def appendList(self, more):  # noqa: N802
        self.v += more

    def clear(self):
        self.v = []


class Mapped(dict):
    def containsKey(self, k):  # noqa: N802
        return k in self

    def getValue(self, k):  # noqa: N802
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        del self[k]


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):  # noqa: N802
        return Value()

    def getListState(self, *_):  # noqa: N802
        return Listed()

    def getMapState(self, *_):  # noqa: N802
        return Mapped()

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


CHUNKS = [(1, 10, "A", None), (2, 20, "B", "interrupt"), (3, 30, "", "stop"), (4, 40, "C", None), (5, 50, "D", "stop"), (6, 60, "open", None)]
MESSAGES = [("t", 10, 20, 2, "AB", "interrupt"), ("t", 40, 50, 2, "CD", "stop")]


def run(batches, **how):
    machine = ordered.Assemble(1, how.get("give_up"), None)
    machine.init(Handle())
    out = []
    for batch in batches:
        out += machine._run(("t",), batch)
    return out, machine


def test_every_order_of_arrival_gives_the_same_messages():
    for order in itertools.permutations(CHUNKS):
        for size in (1, 2, 6):
            out, machine = run([order[i : i + size] for i in range(0, 6, size)])
            assert out == MESSAGES and not machine.early and list(machine.opened.get()) == [(60, "open")]


def test_chunks_that_come_twice_count_once():
    rng = random.Random(1)
    for _ in range(200):
        twice = CHUNKS + rng.sample(CHUNKS, 4)
        rng.shuffle(twice)
        out, machine = run([twice[i : i + 3] for i in range(0, 10, 3)])
        assert out == MESSAGES and not machine.early and machine.spot.get() == (7, 0)


def test_a_gap_is_given_up_after_a_while():
    machine = ordered.Assemble(1, 5, None)
    machine.init(Handle())
    assert machine._run(("t",), [CHUNKS[0], CHUNKS[3], CHUNKS[4]], 1000) == [] and machine.handle.timers == [301_000]
    assert machine._run(("t",), [], 301_000, skip=True) == [("t", 10, 10, 1, "A", "gap"), MESSAGES[1]]
    assert machine._run(("t",), [CHUNKS[1], CHUNKS[5]], 302_000) == []  # too late: its place is past
    assert machine.spot.get() == (7, 0)


class Counted:
    """A state whose calls are counted."""

    def __init__(self, state, calls):
        self.state, self.calls = state, calls

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.state, name)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_early_chunks_cross_blocks(monkeypatch, size):
    monkeypatch.setattr(ordered, "BLOCK", size)
    rng = random.Random(4)
    chunks = [(p, 10 * p, f"<{p}>" if p % 5 else "", "stop" if p % 9 == 0 else None) for p in range(1, 201)]
    want, _ = run([chunks])
    assert len(want) == 18  # 22 marks, 4 of them without a message
    for _ in range(20):
        rng.shuffle(chunks)
        out, machine = run([chunks[i : i + 30] for i in range(0, 200, 30)])
        assert out == want and not machine.early and machine.spot.get() == (201, 0)


def test_a_visit_makes_few_calls_to_the_state():
    """Each is a message to the JVM: they are made by block, not by chunk."""
    chunks = [(p, p, "x", "stop" if p % 10 == 0 else None) for p in range(1, 201)]
    random.Random(5).shuffle(chunks)
    machine, calls, out = ordered.Assemble(1, None, None), [], []
    machine.init(Handle())
    machine.spot, machine.opened, machine.early = (Counted(s, calls) for s in (machine.spot, machine.opened, machine.early))
    for i in range(0, 200, 50):
        out += machine._run(("t",), chunks[i : i + 50])
    assert len(out) == 20 and len(calls) <= 4 * (4 * 3 + 5)


def test_a_stream_waits_for_what_is_missing(spark, tmp_path, monkeypatch):
    """The finish marker first, then the rest; a thread that is never whole gives nothing."""
    late = [[("a", 3, "C", "stop", "r"), ("b", 2, "y", "stop", "r")], [("a", 1, "A", None, "r"), ("c", 1, "z", "stop", "r")], [("a", 2, "B", None, "r"), ("a", 1, "A", None, "r")]]
    monkeypatch.setitem(globals(), "BATCHES", late)
    chunks = stream_of(spark, tmp_path).withColumn("place", F.col("seq"))
    with rocksdb_state(spark):
        threads.write_finished(ordered.assemble_in_order(chunks), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    got = rows(spark.read.parquet(str(tmp_path / "out")), "thread_id", "first_seq", "last_seq", "n_chunks", "text")
    assert got == [("a", 1, 3, 3, "ABC"), ("c", 1, 1, 1, "z")]


# ---- the keyed table

LINE = "k string, ts long, v string, bucket_name string"


def merged(spark, folder, version, lines, **how):
    keyed_table.merge(spark.createDataFrame([(k, t, v, "b") for k, t, v in lines], LINE), folder, version, "k", "ts", **how)
    return rows(keyed_table.read(spark, folder), "k", "ts", "v")


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in (folder / "rows").rglob("*.parquet")}


def test_a_merge_rewrites_what_it_touches(spark, tmp_path):
    folder = str(tmp_path)
    first = merged(spark, folder, 0, [(f"k{i}", 1, "old") for i in range(200)] + [("k1", 0, "older"), (None, 9, "no key")], buckets=16)
    assert len(first) == 200 and ("k1", 1, "old") in first
    before = files(tmp_path)
    got = merged(spark, folder, 1, [("k5", 2, "new"), ("k6", 0, "late"), ("k7", 1, "same time"), ("fresh", 1, "x")])
    want = sorted([(k, t, v) for k, t, v in first if k not in ("k5", "k7")] + [("k5", 2, "new"), ("k7", 1, "same time"), ("fresh", 1, "x")])
    assert got == want
    after = files(tmp_path)
    fresh = {f.split("/")[2] for f in after if f.startswith("rows/v1/")}
    assert 0 < len(fresh) <= 4 and all(after[f] == t for f, t in before.items())  # the version before can still be read
    assert rows(keyed_table.read(spark, folder, 0), "k", "ts", "v") == first
    merged(spark, folder, 2, [("k5", 3, "newer")])
    left = files(tmp_path)
    assert not any(f.startswith("rows/v0/") and f.split("/")[2] in fresh for f in left)  # nobody names these any more
    assert keyed_table.versions(spark, folder) == [0, 1, 2]


def test_a_batch_that_runs_again(spark, tmp_path):
    folder = str(tmp_path)
    merged(spark, folder, 0, [("a", 1, "x"), ("b", 1, "x")], buckets=4)
    once = merged(spark, folder, 1, [("a", 2, "y")])
    assert merged(spark, folder, 1, [("a", 2, "y")]) == once == [("a", 2, "y"), ("b", 1, "x")]
    # one that died before its commit leaves files nobody reads
    keyed_table.merge(spark.createDataFrame([("a", 3, "z", "b")], LINE), folder, 2, "k", "ts")
    assert keyed_table.versions(spark, folder) == [0, 1, 2] and merged(spark, folder, 3, []) == [("a", 3, "z"), ("b", 1, "x")]


def test_an_empty_table(spark, tmp_path):
    assert merged(spark, str(tmp_path), 0, []) == []
    assert merged(spark, str(tmp_path), 1, [("a", 1, "x")]) == [("a", 1, "x")]
