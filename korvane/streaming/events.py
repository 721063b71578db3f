"""Event streams with Structured Streaming: totals by session and a state machine with an idle timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from korvane.operators.sessions import TERMINAL


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(events: DataFrame, key: str, time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events without repeats of their key; what is later than ``delay`` may be forgotten."""
    return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, kind: str, width: str, time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(starts, ends, kind, n): counts in tumbling windows, once a window is older than ``delay``."""
    counts = events.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "kind", "n")


def idle_sessions(events: DataFrame, key: str, gap: str, time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(key, starts, n): runs of a key's events without a pause of ``gap``; a run comes out when it can't grow."""
    runs = events.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("w.start").alias("starts"), "n")


STATE = "status string, n_tokens long, stage string"
OUTPUT = "session_id string, status string, n_tokens long, stage string"


def advance(state: tuple[str, int, str], rows: pd.DataFrame) -> tuple[str, int, str]:
    """The state after rows (seq, type, content), in the order of seq; nothing changes a terminal state."""
    status, n, stage = state
    for kind, content in rows.sort_values("seq")[["type", "content"]].itertuples(index=False):
        if status in TERMINAL:
            break
        if kind == "token":
            n += bool(content)
        elif kind in TERMINAL:
            status = kind
        else:
            stage = content if content is not None else stage
    return status, n, stage


def session_states(events: DataFrame, idle_ms: int, delay: str = "0 seconds") -> DataFrame:
    """States of sessions (session_id, seq, ts, type, content) as they change; one idle for too long ends so."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            now = ("idle_timeout", *state.get[1:])
            state.remove()
        else:
            rows = pd.concat(list(parts))
            now = advance(state.get if state.exists else ("open", 0, ""), rows)
            state.update(now)
            if now[0] not in TERMINAL:
                last = int(pd.Timestamp(rows["ts"].max()).timestamp() * 1000)
                state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"session_id": [key[0]], "status": [now[0]], "n_tokens": [now[1]], "stage": [now[2]]})

    marked = events.withWatermark("ts", delay)
    return marked.groupBy("session_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
