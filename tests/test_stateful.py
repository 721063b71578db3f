"""Keyed state, exactly-once sinks and calls with retries."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest

from korvane.functions import calls
from korvane.operators import sessions
from korvane.streaming import sinks, stateful
from korvane.streaming.events import stream

START = datetime(2024, 1, 1)


@pytest.fixture
def stateful_spark(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield stateful.rocksdb(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(df, out, checkpoint):
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


def requests_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = rng.choices(["save", "get", "delete"], [3, 5, 2])[0]
        rows.append((f"s{rng.randrange(6)}", i, START + timedelta(seconds=10 * i), op, f"u{i % 3}" if op == "save" else None, f"d{i}" if op == "save" else None))
    return rows


def test_sessions_expire_strictly_after_their_time(stateful_spark, tmp_path):
    spark, ttl = stateful_spark, 60
    rows = [("a", 0, START, "save", "u", "x"), ("a", 1, START + timedelta(seconds=60), "get", None, None), ("a", 2, START + timedelta(seconds=61), "get", None, None)]
    path = str(tmp_path / "in")
    put(spark, path, rows, stateful.REQUESTS)
    drain(stateful.session_replies(stream(spark, path, stateful.REQUESTS, 1), ttl), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r.seq: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).where("seq >= 0").collect()}
    assert got == {0: "saved", 1: "loaded", 2: "missing"}  # a read at 60 seconds didn't refresh it


def test_stream_of_sessions_equals_the_batch_over_restarts(stateful_spark, tmp_path):
    spark, ttl, path = stateful_spark, 45, str(tmp_path / "in")
    rows = requests_of(2, 90)
    for part in (rows[:30], rows[30:60], rows[60:]):  # each is a run of its own, from the checkpoint
        put(spark, path, part, stateful.REQUESTS)
        drain(stateful.session_replies(stream(spark, path, stateful.REQUESTS, 1), ttl), str(tmp_path / "out"), str(tmp_path / "c"))
    found = spark.read.parquet(str(tmp_path / "out"))
    columns = ["session_id", "seq", "op", "outcome", "user_id", "data"]
    key = lambda r: (r.seq, r.session_id)
    want = sorted(sessions.replayed(spark.createDataFrame(rows, stateful.REQUESTS), ttl).select(*columns).collect(), key=key)
    got = sorted(found.where("seq >= 0").select(*columns).collect(), key=key)
    assert got == want and {r.outcome for r in got} == {"saved", "loaded", "missing", "deleted"}
    timers = found.where("op = 'timer'").collect()
    assert timers and all(r.outcome == "expired" and r.data for r in timers)


def test_frames_cut_at_every_byte(stateful_spark, tmp_path):
    spark, path = stateful_spark, str(tmp_path / "in")
    events = [{"type": "token", "content": "Grüße \U0001f600"}, {"type": "done", "content": None}]
    text = ": comment\n\n" + "".join(f"data: {json.dumps(e, ensure_ascii=False)}\n\n" for e in events) + "data: {broken\n\ndata: 1\n\ndata: {\"open\": 1}"
    whole = text.encode()
    schema = "connection_id string, seq long, part binary"
    rows = [(f"at{cut}", k, part) for cut in range(len(whole) + 1) for k, part in enumerate((whole[:cut], whole[cut:]))]
    rows += [("bytes", i, whole[i : i + 1]) for i in range(len(whole))]
    put(spark, path, [r for r in rows if r[1] % 2 == 0], schema)
    drain(stateful.decoded(stream(spark, path, schema, 1)), str(tmp_path / "half"), str(tmp_path / "c0"))  # first parts alone
    # one part of every connection in each batch, and the stream begun anew in between
    late = str(tmp_path / "late")
    out, check = str(tmp_path / "out"), str(tmp_path / "c")
    put(spark, late, [r for r in rows if r[0] != "bytes" and r[1] == 0] + [r for r in rows if r[0] == "bytes" and r[1] < 40], schema)
    drain(stateful.decoded(stream(spark, late, schema, 1)), out, check)
    put(spark, late, [r for r in rows if r[0] != "bytes" and r[1] == 1] + [r for r in rows if r[0] == "bytes" and r[1] >= 40], schema)
    drain(stateful.decoded(stream(spark, late, schema, 1)), out, check)
    found = {}
    for r in spark.read.parquet(out).orderBy("n").collect():
        found.setdefault(r.connection_id, []).append((r.n, json.loads(r.event)))
    want = [(0, events[0]), (1, events[1]), (2, 1)]
    assert set(found) == {r[0] for r in rows} and all(x == want for x in found.values())


def test_a_repeated_batch_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(i, "x")], "id long, v string") for i in (1, 2))
    assert sinks.read_batches(spark, path, "id long, v string").count() == 0
    assert sinks.write_batch(one, 0, path) and not sinks.write_batch(two, 0, path)
    assert sinks.write_batch(two, 0, path, "another")
    assert [(r.id, r.writer, r.batch) for r in sinks.read_batches(spark, path, "id long, v string").orderBy("id").collect()] == [(1, "main", 0), (2, "another", 0)]


def test_a_batch_that_died_before_its_record(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "x")], "id long, v string")
    sinks.write_batch(spark.createDataFrame([(0, "w")], "id long, v string"), 0, path)
    rows.write.parquet(sinks._data(path, "main", 1))  # written, not recorded
    assert [r.id for r in sinks.read_batches(spark, path, "id long, v string").collect()] == [0]
    assert sinks.write_batch(rows, 1, path)
    assert sorted(r.id for r in sinks.read_batches(spark, path, "id long, v string").collect()) == [0, 1]


def test_streams_into_sinks(spark, tmp_path):
    source, path, schema = str(tmp_path / "in"), str(tmp_path / "t"), "id long, n long, v string"
    put(spark, source, [(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], schema)
    for more in ([], [(2, 0, "late"), (3, 1, "d")]):
        if more:
            put(spark, source, more, schema)
        query = sinks.start_insert_if_absent(stream(spark, source, schema, 1), path, str(tmp_path / "c"), "id", ["n"])
        assert query.awaitTermination(90)
    assert sorted((r.id, r.v) for r in sinks.read_batches(spark, path, schema).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    query = sinks.start_server_events(stream(spark, source, schema, 1), str(tmp_path / "e"), str(tmp_path / "d"), ["id", "v"])
    assert query.awaitTermination(90)
    frames = {r.frame for r in sinks.read_batches(spark, str(tmp_path / "e"), "frame string").collect()}
    assert 'data: {"id":3,"v":"d"}\n\n' in frames and len(frames) == 5


def test_calls_that_fail_twice_succeed():
    count = {}

    def call(texts):
        out = []
        for t in texts:
            count[t] = count.get(t, 0) + 1
            out.append(ValueError("no") if t == "bad" or t == "shy" and count[t] < 3 else t.upper())
        return out

    assert calls.tried(["a", "shy", "bad"], call, base=0) == [("A", None, 1), ("SHY", None, 3), (None, "ValueError: no", 3)]
    assert count == {"a": 1, "shy": 3, "bad": 3}


def test_a_failing_batch_counts_once_for_each_row():
    seen = []

    def call(texts):
        seen.append(list(texts))
        if len(texts) > 1 or texts == ["b"]:
            raise OSError("down")
        return [t * 2 for t in texts]

    assert calls.tried(["a", "b"], call, base=0) == [("aa", None, 2), (None, "OSError: down", 3)]
    assert seen == [["a", "b"], ["a"], ["b"], ["b"]]
    assert calls.tried([], call) == [] and calls.tried(["a"], lambda t: [], attempts=1, base=0)[0][1].startswith("ValueError")


def test_backoff():
    assert [calls.backoff(n, draw=0) for n in range(8)] == [1, 2, 4, 8, 16, 32, 60, 60]
    assert calls.backoff(1, draw=1) == pytest.approx(2.2) and 1 <= calls.backoff(0) <= 1.1


def test_rejects_go_to_a_table_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i == 5 else f"t{i}") for i in range(200)], "id long, prompt string").repartition(3)

    def call(texts):
        return [RuntimeError("odd") if int(t[1:]) % 10 == 3 else t + "!" for t in texts]

    good, bad = calls.called(rows, "prompt", call, str(tmp_path / "o"), base=0, batch=7)
    answers = {r.id: (r.answer, r.tries) for r in good.collect()}
    rejected = {r.id: (r.error, r.tries) for r in bad.collect()}
    assert set(rejected) == {i for i in range(200) if i % 10 == 3} and set(rejected.values()) == {("RuntimeError: odd", 3)}
    assert answers == {i: (None, 0) if i == 5 else (f"t{i}!", 1) for i in range(200) if i % 10 != 3}
    with pytest.raises(ValueError, match="taken"):
        calls.called(rows.withColumnRenamed("id", "Answer"), "prompt", call, str(tmp_path / "p"))
