"""Corrective retrieval: retrieve, grade, judge the quality, rewrite the query at most twice, report a confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane.functions.models import Embedder, Scorer, letter_embedding, overlap_score

from .search import search_simple
from .stats import answer_confidence

KEEP, GOOD, ANSWER, REWRITES = 0.5, 0.6, 0.6, 2


def first_words(query: str, attempt: int) -> str:
    """The default rewrite: half of the words, at least one."""
    words = query.split()
    return " ".join(words[: max(1, len(words) // 2)])


def corrective_search(
    chunks: DataFrame, query: str, k: int, grade: Scorer = overlap_score, embed: Embedder = letter_embedding, rewrite: Callable[[str, int], str] = first_words, keep: float = KEEP
) -> DataFrame:
    """k graded chunks of the last try, with the query that found them, the answer's confidence, and the outcome.

    The outcome is ``answer`` from a confidence of ANSWER on, else ``insufficient``: there is too little to answer from.
    A try is good enough if the mean of all k grades is GOOD and something is kept.
    """
    for attempt in range(REWRITES + 1):
        found = search_simple(chunks, query, k, embed=embed).withColumn("grade", F.round(grade(query, F.col("chunk_text")), 6))
        kept = F.col("grade") >= keep
        quality = found.agg(F.avg("grade").alias("mean"), F.count_if(kept).alias("n"), F.avg(F.when(kept, F.col("grade"))).alias("kept_mean"))
        seen = quality.first()  # one row
        if attempt == REWRITES or ((seen["mean"] or 0.0) >= GOOD and seen["n"]):
            break
        query = rewrite(query, attempt)
    sure = quality.select(answer_confidence(F.col("kept_mean"), F.col("n")).alias("confidence"))
    sure = sure.withColumn("outcome", F.when(F.col("confidence") >= ANSWER, "answer").otherwise("insufficient"))
    return found.join(F.broadcast(sure)).withColumn("query", F.lit(query)).withColumn("kept", kept)  # one row
