"""Embeddings learned from a table of texts: hashed words, weighted by rarity, projected on their leading singular vectors.

A text is a sparse row of A: for each bucket of its words, log(1 + occurrences) times the bucket's inverse frequency, scaled
to length 1. ``fit`` finds the leading right singular vectors of A by randomised subspace iteration: a round is one pass
over the rows, in which tasks multiply their rows with the current basis and back, and Spark sums BUCKETS * (dimension +
EXTRA) numbers. An embedding is the row times those vectors, scaled to length 1 again.

Rows are sampled by a hash for the fit (FIT_TEXTS of them, about); embedding is for all texts. A null text and one without
words give zeros. A fit of no texts gives a model whose embeddings are all zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector_index import unit_rows
from korvane.functions.models import tokens_of
from korvane.session import exists, small_batches

#: Hash buckets of words; singular vectors beyond those asked for; rounds; texts of the fit. The first two bound what is broadcast.
BUCKETS, EXTRA, ROUNDS, FIT_TEXTS = 4096, 8, 5, 100_000


def bucketed(text: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each word of a text."""
    return F.transform(tokens_of(text), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


class SparseRows:
    """The weighted words of some texts: of entry i, the text ``row[i]``, the bucket ``column[i]`` and the weight ``value[i]``."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, rarity: np.ndarray):
        self.n, buckets = len(sizes), len(rarity)
        cells, counts = np.unique(np.repeat(np.arange(self.n), sizes) * buckets + words, return_counts=True)
        self.row, self.column = cells // buckets, cells % buckets
        value = np.log1p(counts) * rarity[self.column]
        norms = np.sqrt(np.bincount(self.row, value * value, self.n))
        self.value = value / np.where(norms > 0, norms, 1)[self.row]

    def times(self, basis: np.ndarray) -> np.ndarray:
        """A times a dense matrix."""
        return np.stack([np.bincount(self.row, self.value * basis[self.column, j], self.n) for j in range(basis.shape[1])], 1)

    def transposed_times(self, dense: np.ndarray, buckets: int) -> np.ndarray:
        return np.stack([np.bincount(self.column, self.value * dense[self.row, j], buckets) for j in range(dense.shape[1])], 1)


def of_batch(column: pa.ListArray, rarity: np.ndarray) -> SparseRows:
    return SparseRows(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy()), rarity)


def _summed(rows: DataFrame, column: str, work, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of what ``work`` makes of their batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += work(batch.column(0))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], names=["cell", "x"])

    out = np.zeros(int(np.prod(shape)))
    for cell, x in rows.select(column).mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        out[cell] = x
    return out.reshape(shape)


@dataclass(frozen=True)
class EmbeddingModel:
    rarity: np.ndarray
    axes: np.ndarray

    @property
    def dimension(self) -> int:
        return self.axes.shape[1]

    def __call__(self, text: Column) -> Column:
        """The embedding of a text: an Embedder; ``small_batches`` of the rows bounds what a worker holds."""
        rarity, axes = self.rarity, self.axes

        @F.pandas_udf("array<double>")
        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for words in parts:
                sizes = np.array([len(w) for w in words])
                flat = np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64)
                rows = unit_rows(SparseRows(flat, sizes, rarity).times(axes))
                yield pd.Series(list(np.round(rows, 9)))

        return embed(bucketed(text, len(rarity)))

    def write(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(r), a) for i, (r, a) in enumerate(zip(self.rarity, self.axes.tolist(), strict=True))]
        spark.createDataFrame(rows, "bucket int, rarity double, axis array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> EmbeddingModel:
    if not exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"{path} is no finished model")
    rows = spark.read.parquet(path).orderBy("bucket").collect()  # a row for each bucket
    return EmbeddingModel(np.array([r["rarity"] for r in rows]), np.array([r["axis"] for r in rows]))


def fit(docs: DataFrame, text_col: str = "text", dimension: int = 32, buckets: int = BUCKETS, rounds: int = ROUNDS, fit_texts: int = FIT_TEXTS, seed: int = 7, work_dir: str | None = None) -> EmbeddingModel:
    """Learn a model. With ``work_dir``, the hashed words of the sample are written there and read in each round."""
    text = F.col(f"`{text_col}`")
    known = small_batches(docs).where(text.isNotNull()).select(text.alias("text"))
    share = min(1.0, fit_texts / max(1, known.count()))
    words = known.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).select(bucketed(F.col("text"), buckets).alias("w")).where(F.size("w") > 0)
    if work_dir:
        words.write.mode("overwrite").parquet(work_dir)
        words = docs.sparkSession.read.schema("w array<int>").parquet(work_dir)

    def counted(column: pa.ListArray) -> np.ndarray:
        sparse = of_batch(column, np.ones(buckets))
        return np.append(np.bincount(sparse.column, minlength=buckets), sparse.n)

    counts = _summed(words, "w", counted, (buckets + 1,))
    n, df = counts[-1], counts[:-1]
    width = min(dimension + EXTRA, buckets)
    if not n:
        return EmbeddingModel(np.zeros(buckets), np.zeros((buckets, dimension)))
    rarity = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1e-3, 0)  # a word of all texts says next to nothing
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width)))[0]
    for _ in range(rounds):
        there_and_back = _summed(words, "w", _product(rarity, basis), basis.shape)
        small = basis.T @ there_and_back
        last, basis = basis, np.linalg.qr(there_and_back)[0]
    values, turn = np.linalg.eigh((small + small.T) / 2)
    axes = (last @ turn[:, np.argsort(-values)])[:, :dimension]
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)  # a singular vector's sign is free
    return EmbeddingModel(rarity, np.pad(axes, ((0, 0), (0, dimension - axes.shape[1]))))


def _product(rarity: np.ndarray, basis: np.ndarray):
    def work(column: pa.ListArray) -> np.ndarray:
        sparse = of_batch(column, rarity)
        return sparse.transposed_times(sparse.times(basis), len(rarity))

    return work
