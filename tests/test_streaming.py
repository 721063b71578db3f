"""Streams replayed from files, against the same by batch."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from korvane.streaming import events

SCHEMA = "session_id string, seq long, ts timestamp, type string, content string"
START = datetime(2024, 1, 1)


def at(seconds: int) -> datetime:
    return START + timedelta(seconds=seconds)


@pytest.fixture
def folder(spark, tmp_path):
    """Two files, the second of which moves time on."""
    first = [("a", 1, at(0), "token", "x"), ("a", 2, at(1), "stage", "find"), ("a", 3, at(2), "done", None), ("a", 4, at(3), "token", "y"), ("b", 1, at(0), "token", "z")]
    path = str(tmp_path / "in")
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(path)
    spark.createDataFrame([("c", 1, at(500), "token", "w")], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def replay(df, name: str, tmp_path) -> list:
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    try:
        query.awaitTermination(90)
    finally:
        query.stop()
    return df.sparkSession.table(name).collect()


def test_a_state_ends_by_itself_or_by_idling(spark, folder, tmp_path):
    stream = events.stream(spark, folder, SCHEMA, 1)
    rows = {}
    for r in replay(events.session_states(stream, 60_000), "states", tmp_path):
        rows.setdefault(r.session_id, []).append((r.status, r.n_tokens, r.stage))
    assert rows["a"] == [("done", 1, "find")]
    assert rows["b"][0] == ("open", 1, "")
    assert rows["b"][-1] in (("idle_timeout", 1, ""), ("open", 1, ""))
    assert rows["c"][0] == ("open", 1, "")


def test_state_machine():
    rows = pd.DataFrame([(2, "done", None), (1, "token", "x"), (3, "token", "y")], columns=["seq", "type", "content"])
    assert events.advance(("open", 0, ""), rows) == ("done", 1, "")
    assert events.advance(("error", 5, "s"), rows) == ("error", 5, "s")


def test_windows_and_sessions_equal_batch_but_for_the_last(spark, folder, tmp_path):
    stream = events.stream(spark, folder, SCHEMA, 1)
    got = replay(events.windowed(stream, "type", "10 seconds", delay="1 second"), "windows", tmp_path)
    assert {(r.kind, r.n) for r in got} == {("token", 3), ("stage", 1), ("done", 1)}
    got = replay(events.idle_sessions(stream, "session_id", "60 seconds", delay="1 second"), "runs", tmp_path)
    assert {(r.session_id, r.n) for r in got} == {("a", 4), ("b", 1)}


def test_repeats_go(spark, folder, tmp_path):
    twice = events.stream(spark, folder, SCHEMA, 1).withColumn("id", F.concat("session_id", "seq")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert len(replay(events.once(twice, "id"), "once", tmp_path)) == 6
