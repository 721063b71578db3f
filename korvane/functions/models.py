"""Pluggable model functions. Every model is a column function; the defaults are deterministic and need no file.

``embed(text)`` gives an array of doubles, ``score(query, text)`` a double. The defaults count letters and shared words;
they stand in for trained models and don't claim their quality. Any Arrow UDF of the same shape may replace them.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[Column], Column]
Scorer = Callable[[str, Column], Column]

#: ``complete(prompt)`` gives a language model's answer.
Completer = Callable[[Column], Column]
INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_embedding(text: Column) -> Column:
    """How often each letter a to z occurs, 26 numbers."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c)))).cast("double") for c in LETTERS])


def tokens_of(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def overlap_score(query: str, text: Column) -> Column:
    """The share of the query's distinct words that the text has; 0 for a query without words."""
    words = sorted({w for w in query.lower().split() if w})
    if not words:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array(*map(F.lit, words)), tokens_of(text))) / F.lit(float(len(words)))


def normalised(vector: Column) -> Column:
    """``vector`` divided by its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm == 0, vector.cast("array<double>")).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))


def mean_pooled(vectors: Column) -> Column:
    """The normalised mean of an array of equally long vectors; null if there is none."""
    n = F.size(vectors)
    total = F.aggregate(
        F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), F.get(vectors, F.lit(0)).cast("array<double>"), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double"))
    )
    return F.when(n > 0, normalised(F.transform(total, lambda x: x / n)))


def yes_probability(no: Column, yes: Column) -> Column:
    """Soft-max of two logits."""
    return 1.0 / (1.0 + F.exp(no - yes))


def rerank_prompt(query: str, text: Column, instruction: str = INSTRUCTION) -> Column:
    return F.format_string("<Instruct>: %s\n<Query>: %s\n<Document>: %s", F.lit(instruction), F.lit(query), text)


def first_line(prompt: Column) -> Column:
    """The default completion: the first line of the prompt, as a stand-in that any model may replace."""
    return F.btrim(F.split(F.coalesce(prompt, F.lit("")), "\n", 2)[0])


def answered(rows: DataFrame, prompt: Column, out: str = "response", complete: Completer = first_line) -> DataFrame:
    """``rows`` with the model's answer to each prompt."""
    return rows.withColumn(out, complete(prompt))


def bpe_token_count(ranks_path: str, pattern: str) -> Callable[[Column], Column]:
    """A token count by a byte-level vocabulary of ranks, in place of the four-characters rule; a null text has none."""

    def count(text: Column) -> Column:
        @F.pandas_udf("int")
        def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
            encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for texts in parts:
                yield texts.fillna("").map(lambda t: len(encoding.encode_ordinary(t))).astype("int32")

        return counted(text)

    return count
