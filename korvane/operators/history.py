"""Conversation history: filter and tail, retrieval query, context, routing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.functions.text import sse_events

# Fixed values of the keyword classifier.
EMOTIONAL = ("anxious", "feeling", "depressed", "sad", "stressed", "worried", "emotional", "upset", "down", "struggling", "need to talk", "need someone")
GREETINGS = ("thank", "thanks", "hello", "hi", "hey", "goodbye", "bye")

LABELS = {"user": "User", "human": "User", "assistant": "Assistant", "ai": "Assistant", "system": "System"}


def tail(messages: DataFrame, roles: Sequence[str], last: int, include_system: bool = False) -> DataFrame:
    """The last messages of these roles in each conversation, with ``back`` counted from 1 at the end; all if last <= 0."""
    kept = messages.where(F.col("role").isin(*roles, *(["system"] if include_system else [])))
    back = kept.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return back.where(F.col("back") <= last) if last > 0 else back


def _joined(rows: DataFrame, text: Column, sep: str, name: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", text.alias("t"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["t"]), sep).alias(name))


def retrieval_query(messages: DataFrame, last: int = 1, include_system: bool = False) -> DataFrame:
    """(conv_id, query): the last user messages joined by line; empty ones are left out after the slice."""
    rows = tail(messages, ("user", "human"), last, include_system)
    text = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.col("text"))
    joined = _joined(rows, text, "\n", "query")
    return messages.select("conv_id").distinct().join(joined, "conv_id", "left").select("conv_id", F.coalesce("query", F.lit("")).alias("query"))


def context(messages: DataFrame, last: int = 5, drop: int = 0, include_system: bool = False) -> DataFrame:
    """(conv_id, context): the last messages but for ``drop`` of them at the end, each after its role's label."""
    rows = tail(messages, ("user", "human", "assistant", "ai"), last, include_system).where(F.col("back") > drop)
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    text = F.concat(F.coalesce(F.try_element_at(labels, F.col("role")), F.lit("Unknown")), F.lit(": "), F.coalesce("text", F.lit("")))
    joined = _joined(rows, text, "\n", "context")
    return messages.select("conv_id").distinct().join(joined, "conv_id", "left").select("conv_id", F.coalesce("context", F.lit("")).alias("context"))


def full_history(messages: DataFrame) -> DataFrame:
    """(conv_id, history): all messages but the system's, each after its role's label."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    text = F.concat(F.coalesce(F.try_element_at(labels, F.col("role")), F.lit("Unknown")), F.lit(": "), F.coalesce("text", F.lit("")))
    joined = _joined(messages.where(F.coalesce("role", F.lit("")) != "system"), text, "\n", "history")
    none = F.lit("No prior messages available.")
    return messages.select("conv_id").distinct().join(joined, "conv_id", "left").select("conv_id", F.coalesce("history", none).alias("history"))


def decode_chunks(chunks: DataFrame, key: str, order: str, chunk_col: str) -> DataFrame:
    """(key, seq, event): the events of server-sent chunks, which may be cut anywhere; a stream's chunks are joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(chunk_col, F.lit("")).alias("c"))))
    joined = chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["c"]), "").alias("stream"))
    return joined.select(key, F.posexplode(sse_events(F.col("stream"))).alias("seq", "event"))


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def classify(text: Column) -> tuple[Column, Column]:
    """Agent and intent of a message by keywords; greetings count as whole words only."""
    low = F.lower(F.coalesce(text, F.lit("")))
    agent = F.when(_any(low, EMOTIONAL), "emotional_support").otherwise("rag_agent")
    intent = F.when(low.rlike(rf"\b({'|'.join(GREETINGS)})\b"), "respond").otherwise("retrieve")
    return agent, intent


def classify_messages(messages: DataFrame) -> DataFrame:
    agent, intent = classify(F.col("text"))
    return messages.where(F.col("role") == "user").select("conv_id", "turn", agent.alias("agent"), intent.alias("intent"))


def sticky_agent(messages: DataFrame) -> DataFrame:
    """(conv_id, agent): the last agent that was assigned, else the supervisor decides."""
    return messages.groupBy("conv_id").agg(F.coalesce(F.max_by("agent", F.when(F.col("agent").isNotNull(), F.col("turn"))), F.lit("supervisor")).alias("agent"))


def answer_events(answers: DataFrame, key: list[str], text_col: str, stage: str = "generation") -> DataFrame:
    """(key, seq, type, content): the events of each answer in the order in which a stream sends them.

    ``metadata`` comes first with the key as JSON, then the start of the stage, a ``token`` for each word with the white
    space after it, the end of the stage and ``done``; seq is from 0. An empty answer has no tokens.
    """
    event = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"))
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^ ]+ *| +"), F.lit(0))
    tokens = F.transform(words, lambda w: event("token", w))
    around = lambda kind, content: F.array(event(kind, content))
    stages = [around(k, F.lit(stage)) for k in ("stage_start", "stage_complete")]
    whole = F.concat(around("metadata", F.to_json(F.struct(*key))), stages[0], tokens, stages[1], around("done", F.lit(None).cast("string")))
    return answers.select(*key, F.posexplode(whole).alias("seq", "event")).select(*key, F.col("seq").cast("long").alias("seq"), "event.*")
