"""Keyed state on a stream: sessions with a time-to-live, and frames whose parts arrive in pieces.

Both use ``transformWithStateInPandas``, so state lives in RocksDB with the checkpoint, key by key, and survives a restart.
``rocksdb`` sets the session up for it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REQUESTS = "session_id string, seq long, ts timestamp, op string, user_id string, data string"
REPLIES = "session_id string, seq long, op string, outcome string, user_id string, data string"


def rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def reply(state: tuple | None, op: str, ts: int, user_id: str | None, data: str | None, ttl_ms: int) -> tuple[tuple | None, str, str | None, str | None]:
    """The state (user_id, data, updated) after a request, its outcome, and the session that it returns.

    ``save`` writes and sets the time, ``get`` only reads, ``delete`` removes. Once more than ``ttl_ms`` have passed since
    a session was saved, it is missing.
    """
    if state is not None and ts - state[2] > ttl_ms:
        state = None
    if op == "save":
        return (user_id, data, ts), "saved", user_id, data
    if op == "delete":
        return None, "deleted" if state is not None else "missing", None, None
    return (state, "loaded", state[0], state[1]) if state is not None else (None, "missing", None, None)


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


class SessionStore(StatefulProcessor):
    """Sessions by id. A timer just after the time-to-live removes what nobody asks for; it says so with a row of its own."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "user_id string, data string, updated long")

    def _timer(self, state: tuple | None) -> int | None:
        return None if state is None else state[2] + self.ttl_ms + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.session.get()) if self.session.exists() else None
        state, out = before, []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).astype(object).itertuples():
            user_id, data = (None if pd.isna(x) else x for x in (r.user_id, r.data))
            state, outcome, user_id, data = reply(state, r.op, _millis(r.ts), user_id, data, self.ttl_ms)
            out.append((key[0], r.seq, r.op, outcome, user_id, data))
        if state != before:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            if state is None:
                self.session.clear()
            else:
                self.session.update(state)
                # one that is over by the stream's own time goes with the next batch
                self.handle.registerTimer(max(self._timer(state), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "seq", "op", "outcome", "user_id", "data"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.session.exists():
            user_id, data, _ = self.session.get()
            self.session.clear()
            yield pd.DataFrame({"session_id": [key[0]], "seq": [-1], "op": ["timer"], "outcome": ["expired"], "user_id": [user_id], "data": [data]})

    def close(self) -> None:
        pass


def session_replies(requests: DataFrame, ttl_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """REPLIES of a stream of REQUESTS, in event time; of one session in the order of (ts, seq) within a batch.

    What is later than ``delay`` behind the newest request is dropped, as every watermark does.
    """
    marked = requests.withWatermark("ts", delay)
    return marked.groupBy("session_id").transformWithStateInPandas(SessionStore(1000 * ttl_seconds), REPLIES, "Append", "EventTime")


class FrameDecoder(StatefulProcessor):
    """Events of a connection whose bytes come in parts: what follows the last whole frame waits as a list of parts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "part binary")
        self.sent = handle.getValueState("sent", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [bytes(x) for x in pd.concat(list(rows)).sort_values("seq")["part"] if x is not None]
        held = [bytes(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        n = self.sent.get()[0] if self.sent.exists() else 0
        *frames, rest = (b"".join([*held, *parts])).split(b"\n\n")
        out = []
        for frame in frames:
            event = event_of(frame)
            if event is not None:
                out.append((key[0], n, event))
                n += 1
        if not frames:
            if parts:
                self.waiting.appendList([(p,) for p in parts])
        elif rest:
            self.waiting.put([(rest,)])
        else:
            self.waiting.clear()
        if out:
            self.sent.update((n,))
        yield pd.DataFrame(out, columns=["connection_id", "n", "event"])

    def close(self) -> None:
        pass


def event_of(frame: bytes) -> str | None:
    """The JSON text of a whole frame; None for a comment or what isn't JSON."""
    text = frame.decode("utf-8", "replace").strip(" \t\r\n")
    if not text.startswith("data: "):
        return None
    try:
        json.loads(text[6:])
    except ValueError:
        return None
    return text[6:]


def decoded(parts: DataFrame) -> DataFrame:
    """(connection_id, n, event): the events of a stream of (connection_id, seq, part binary), numbered by connection."""
    return parts.groupBy("connection_id").transformWithStateInPandas(FrameDecoder(), "connection_id string, n long, event string", "Append", "None")
