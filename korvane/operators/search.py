"""Retrieval strategies: simple, rerank, advanced. Each takes chunks and messages or a query, and returns k rows."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions.models import Embedder, Scorer, letter_embedding, overlap_score

from .vector import DIGITS, OVERFETCH, dedup_first, metadata_filter, top_k, top_k_each


def embed_queries(spark: SparkSession, queries: Sequence[str], embed: Embedder = letter_embedding) -> list[list[float]]:
    """The vectors of a few queries."""
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "i int, q string").select("i", embed(F.col("q")).alias("v")).orderBy("i").collect()
    return [list(r["v"]) for r in rows]


def _check(query: str, k: int) -> None:
    if not query.strip() or k <= 0:
        raise ValueError("a query and a positive k are needed")


def search_simple(chunks: DataFrame, query: str, k: int, filters: Mapping[str, str] | None = None, embed: Embedder = letter_embedding) -> DataFrame:
    _check(query, k)
    return top_k(metadata_filter(chunks, filters), embed_queries(chunks.sparkSession, [query], embed)[0], k)


def rerank(candidates: DataFrame, query: str, k: int, score: Scorer = overlap_score, order: Sequence = ()) -> DataFrame:
    """Candidates by the scorer; ties keep the order in which they came."""
    scored = candidates.withColumn("rerank_score", F.round(score(query, F.col("chunk_text")), DIGITS))
    return scored.orderBy(F.desc("rerank_score"), *order, "chunk_id").limit(k)


def search_rerank(chunks: DataFrame, query: str, k: int, filters: Mapping[str, str] | None = None, embed: Embedder = letter_embedding, score: Scorer = overlap_score) -> DataFrame:
    """Four times k by vectors, then k by the scorer, which only sees those."""
    found = search_simple(chunks, query, OVERFETCH * k, filters, embed)
    return rerank(found, query, k, score, [F.desc_nulls_last("similarity_score")])


def search_advanced(
    chunks: DataFrame, query: str, variations: Sequence[str], k: int, filters: Mapping[str, str] | None = None, embed: Embedder = letter_embedding, score: Scorer = overlap_score
) -> DataFrame:
    """k for each variation of the query, each chunk once with its first score, then k by the scorer and the query."""
    _check(query, k)
    vectors = embed_queries(chunks.sparkSession, variations, embed)
    found = dedup_first(top_k_each(metadata_filter(chunks, filters), vectors, k))
    return rerank(found, query, k, score, ["variation", "rank"])


STRATEGIES = ("simple", "rerank", "advanced")


def search(strategy: str, chunks: DataFrame, query: str, k: int, variations: Sequence[str] = (), score: Scorer | None = overlap_score, **kwargs) -> DataFrame:
    """A strategy by its name, in any case."""
    name = strategy.lower()
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}: one of {', '.join(STRATEGIES)}")
    if name == "simple":
        return search_simple(chunks, query, k, **kwargs)
    if score is None:
        raise AssertionError(f"{name} needs a scorer")
    if name == "rerank":
        return search_rerank(chunks, query, k, score=score, **kwargs)
    return search_advanced(chunks, query, variations or [query] * 4, k, score=score, **kwargs)


def rerank_indexed(requests: DataFrame, query: str, score: Scorer = overlap_score) -> DataFrame:
    """(..., index, score): every text of each request, an array ``texts`` in a row, with its place, best first in its request."""
    others = [c for c in requests.columns if c != "texts"]
    scored = requests.select(*[F.col(f"`{c}`") for c in others], F.posexplode("texts").alias("index", "text"))
    scored = scored.select(*[F.col(f"`{c}`") for c in others], "index", F.round(score(query, F.col("text")), DIGITS).alias("score"))
    return scored.orderBy(*[F.col(f"`{c}`") for c in others], F.desc("score"), "index") if others else scored.orderBy(F.desc("score"), "index")


def rerank_or_keep(candidates: DataFrame, query: str, k: int, score: Scorer | None) -> DataFrame:
    """As ``rerank``; without a scorer, with one that fails, or for a single candidate, the order stays and the score is null.

    The candidates are few, and are scored at once, so that a failure shows here.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    kept = candidates.withColumn("rerank_score", F.lit(None).cast("double")).orderBy(F.desc_nulls_last("similarity_score"), "chunk_id").limit(k)
    if score is None or candidates.limit(2).count() < 2:
        return kept
    ranked = rerank(candidates, query, k, score, [F.desc_nulls_last("similarity_score")])
    try:
        found = ranked.collect()  # k rows
    except Exception as error:
        warnings.warn(f"the scorer failed, the order stays: {error}", RuntimeWarning, stacklevel=2)
        return kept
    return candidates.sparkSession.createDataFrame(found, ranked.schema)
