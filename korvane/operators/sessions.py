"""Sessions and event streams as tables: latest state, time-to-live, ownership, idle gaps, accumulated events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.session import unused

TERMINAL = ("error", "done", "cancelled", "idle_timeout")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; aggregates combine before the shuffle, so a key of many rows is no burden."""
    rest = [c for c in rows.columns if c != key]
    top = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(key, "_r.*")


def live(sessions: DataFrame, now: datetime | Column, ttl_seconds: int) -> DataFrame:
    """Sessions that haven't expired: older than the time-to-live is expired, just as old is not."""
    now = now if isinstance(now, Column) else F.lit(now)
    return sessions.where(F.col("updated_at") >= now - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))


def expired(sessions: DataFrame, now: datetime | Column, ttl_seconds: int) -> DataFrame:
    return sessions.join(live(sessions, now, ttl_seconds).select("session_id"), "session_id", "left_anti")


def deleted(sessions: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Sessions without those of ``session_ids`` (session_id)."""
    return sessions.join(session_ids.select("session_id"), "session_id", "left_anti")


def clear_expired(sessions: DataFrame, now: datetime | Column, ttl_seconds: int) -> tuple[DataFrame, int]:
    """The sessions that stay, and how many had expired."""
    return live(sessions, now, ttl_seconds), expired(sessions, now, ttl_seconds).count()


def of_user(sessions: DataFrame, user_id, now: datetime | Column, ttl_seconds: int) -> DataFrame:
    """A user's live sessions, the most recent first."""
    return live(sessions, now, ttl_seconds).where(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), "session_id")


def create_or_load(requests: DataFrame, sessions: DataFrame, now: datetime | Column, ttl_seconds: int) -> DataFrame:
    """(request_id, session_id, outcome): ``loaded``, ``created`` for none, a missing or an expired one, ``forbidden`` for another's."""
    owner = unused(requests, "_owner")
    known = live(sessions, now, ttl_seconds).select("session_id", F.col("user_id").alias(owner))
    joined = requests.join(known, "session_id", "left")
    outcome = F.when(F.col(owner).isNull(), "created").when(F.col(owner) == F.col("user_id"), "loaded").otherwise("forbidden")
    return joined.select("request_id", "session_id", outcome.alias("outcome"))


def replayed(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """(session_id, seq, op, outcome, user_id, data): what a store answers to requests (session_id, seq, ts, op, user_id, data).

    In the order of (ts, seq), ``save`` writes a session and sets its time, ``get`` only reads it and ``delete`` removes it.
    It is missing once more than the time-to-live has passed since it was saved. The stream of the same is
    ``korvane.streaming.stateful.session_replies``.
    """
    kind = F.col("op")
    before = Window.partitionBy("session_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(kind.isin("save", "delete"), F.struct("op", "user_id", "data", F.col("ts").alias("at")))
    last = F.last(write, ignorenulls=True).over(before)
    known = requests.select("session_id", "seq", "op", "user_id", "data", "ts", last.alias("last"))
    live = F.coalesce((F.col("last.op") == "save") & (F.col("last.at") >= F.col("ts") - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")), F.lit(False))
    outcome = F.when(kind == "save", "saved").when(~live, "missing").when(kind == "delete", "deleted").otherwise("loaded")
    shown = lambda c: F.when(kind == "save", F.col(c)).when(live & (kind == "get"), F.col(f"last.{c}")).alias(c)
    return known.select("session_id", "seq", "op", outcome.alias("outcome"), shown("user_id"), shown("data"))


def until_terminal(events: DataFrame, key: str, order: str, type_col: str = "type", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Events up to the first terminal one of each stream, that one included; a stream without one stays whole."""
    end = unused(events, "_end")
    ends = events.where(F.col(type_col).isin(*terminal)).groupBy(key).agg(F.min(order).alias(end))
    return events.join(ends, key, "left").where(F.col(end).isNull() | (F.col(order) <= F.col(end))).drop(end)


def accumulate(events: DataFrame, key: str, order: str, token: Column, stage: Column, type_col: str = "type", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """For each stream: its tokens in order, their number, the last stage, and the terminal state if it has one."""
    t, s = unused(events, "_t"), unused(events, "_s")
    rows = until_terminal(events, key, order, type_col, terminal).withColumn(t, token).withColumn(s, stage)
    tokens = F.array_sort(F.collect_list(F.when(F.col(t).isNotNull(), F.struct(F.col(order).alias("o"), F.col(t).alias("t")))))
    return rows.groupBy(key).agg(
        F.array_join(F.transform(tokens, lambda x: x["t"]), "").alias("answer"), F.count(t).alias("n_tokens"),
        F.max_by(s, F.when(F.col(s).isNotNull(), F.col(order))).alias("stage"),
        F.coalesce(F.max(F.when(F.col(type_col).isin(*terminal), F.col(type_col))), F.lit("open")).alias("status"),
    )


def idle_sessions(events: DataFrame, key: str, time_col: str, gap: str) -> DataFrame:
    """Runs of a key's events with less than ``gap`` between neighbours: (key, starts, ends, n)."""
    ts, w = unused(events, "_ts"), unused(events, "_w")
    rows = events.withColumn(ts, F.col(time_col).cast("timestamp"))
    return rows.groupBy(key, F.session_window(ts, gap).alias(w)).agg(F.min(time_col).alias("starts"), F.max(time_col).alias("ends"), F.count("*").alias("n")).drop(w)
