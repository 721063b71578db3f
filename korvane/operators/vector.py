"""Exact vector search: filters, similarities, top-k, sign-bit search. Queries are given as lists of numbers.

A top-k is ``orderBy(...).limit(k)``, which Spark runs as a top-k of each partition; no sort of the table is shuffled.
Scores are rounded before they are ordered and ties go to the smaller id, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.session import unused

#: Columns that a metadata filter may name; others are dropped without a word, as is a filter of only those.
FILTERABLE = ("source_document", "chapter_title")
OVERFETCH = 4
DIGITS = 6


def _vector(query: Sequence[float]) -> Column:
    return F.lit([float(x) for x in query]).cast("array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: Column) -> Column:
    """Null for a zero vector: no angle is defined."""
    return F.try_divide(_dot(vector, query), F.sqrt(_dot(vector, vector)) * F.sqrt(_dot(query, query)))


def inner_product(vector: Column, query: Column) -> Column:
    return _dot(vector, query)


def l2_squared(vector: Column, query: Column) -> Column:
    return F.aggregate(F.zip_with(vector, query, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def metadata_filter(rows: DataFrame, filters: Mapping[str, str] | None, allowed: Sequence[str] = FILTERABLE) -> DataFrame:
    """Rows for which ANY of the known filters holds. A null value matches nothing (``=``, not ``<=>``)."""
    clauses = [F.col(k) == F.lit(v) for k, v in (filters or {}).items() if k in allowed]
    return rows.where(reduce(or_, clauses)) if clauses else rows


def top_k(rows: DataFrame, query: Sequence[float], k: int, id_col: str = "chunk_id", vector_col: str = "embedding", metric: str = "cosine", score_col: str = "similarity_score") -> DataFrame:
    """The k best rows without their vectors: largest cosine or inner product, or smallest squared distance."""
    if k <= 0:
        raise ValueError("k must be positive")
    measure = {"cosine": cosine, "inner": inner_product, "l2": l2_squared}[metric]
    scored = rows.withColumn(score_col, F.round(measure(F.col(vector_col), _vector(query)), DIGITS)).drop(vector_col)
    best = F.asc_nulls_last(score_col) if metric == "l2" else F.desc_nulls_last(score_col)
    return scored.orderBy(best, id_col).limit(k)


def top_k_each(rows: DataFrame, queries: Sequence[Sequence[float]], k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows of each query, with variation and rank from 0.

    The first scan finds their ids: it has ids and scores alone, and ``row_number() <= k`` is also applied within each
    partition before the shuffle, which so moves k rows of each partition and query at most. The second one reads the rest
    of the rows with these ids, and orders them in the same way.
    """
    scores = F.array(*[F.struct(F.lit(i).alias("variation"), F.round(cosine(F.col(vector_col), _vector(q)), DIGITS).alias("similarity_score")) for i, q in enumerate(queries)])
    number, near = unused(rows, "_number"), unused(rows, "_near")

    def best(scored: DataFrame) -> DataFrame:
        order = Window.partitionBy("variation").orderBy(F.desc_nulls_last("similarity_score"), id_col)
        return scored.withColumn(number, F.row_number().over(order)).where(F.col(number) <= k)  # of this form alone Spark limits partitions

    ids = best(rows.select(id_col, F.inline(scores))).select(F.col(id_col).alias(near)).distinct()
    few = rows.join(F.broadcast(ids), F.col(id_col).eqNullSafe(F.col(near)), "left_semi")  # k rows of a query
    return best(few.select("*", F.inline(scores)).drop(vector_col)).withColumn("rank", F.col(number) - 1).drop(number)


def dedup_first(found: DataFrame, id_col: str = "chunk_id", order: Sequence[str] = ("variation", "rank")) -> DataFrame:
    """The first occurrence of each id, in the given order; its score is the first one's."""
    window = Window.partitionBy(id_col).orderBy(*order)
    first = unused(found, "_first")
    return found.withColumn(first, F.row_number().over(window)).where(F.col(first) == 1).drop(first)


def sign_words(vector: Column, dimension: int) -> Column:
    """The signs (1: positive) as an array of longs of 32 bits each."""
    words = []
    for begin in range(0, dimension, 32):
        bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << (i - begin))).otherwise(F.lit(0)).cast("long") for i in range(begin, min(dimension, begin + 32))]
        words.append(reduce(lambda a, b: a + b, bits))
    return F.array(*words)


def signs_of(query: Sequence[float]) -> Column:
    """``sign_words`` of a query."""
    return F.array(*[F.lit(sum(1 << (i - b) for i in range(b, min(len(query), b + 32)) if query[i] > 0)).cast("long") for b in range(0, len(query), 32)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming_top_k(rows: DataFrame, query: Sequence[float], k: int, candidates: int = 100, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The candidates of the smallest Hamming distance of signs, ordered again by exact cosine."""
    near = rows.withColumn("hamming", hamming(sign_words(F.col(vector_col), len(query)), signs_of(query))).orderBy("hamming", id_col).limit(candidates)
    return top_k(near, query, k, id_col, vector_col)


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def bad_vectors(rows: DataFrame, dimension: int, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector is missing, of another size, or holds what isn't a finite number."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(v.isNull() | (F.size(v) != dimension) | odd)
