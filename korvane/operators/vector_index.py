"""A stored index of vectors: inverted lists around k-means centroids, and codes of few bits beside the vectors.

An index is a folder of Parquet tables:

* ``vectors`` (id, vector, and what other columns were kept), in a folder for each list, so that a search reads the lists it probes;
* ``codes`` (id, signs, half), in the same folders: the signs in longs of 32 bits, and the vector as 16-bit floats. A first
  phase reads these alone, 1/32 and 1/2 of what the vectors are;
* ``centroids`` (list, centroid, n): at most MAX_LISTS rows; ``about``, one row, written last: an index counts once it is there.

Centroids come from mini-batches of a bounded sample (TRAIN_ROWS of a list); every row is assigned to the nearest. How many
lists a search probes is measured when the index is made: as many as give ``recall`` of the exact neighbours of
TUNE_QUERIES rows. Searching all lists is exact.

Vectors are compared by cosine. A null vector, one of another length, and one without a direction (zeros, or numbers that
aren't finite) are in no list and never found. Ids should be unique; a repeated one is found as often as it is there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from korvane.session import exists

from .vector import DIGITS, hamming, sign_words, signs_of, top_k

#: Bounds: centroids, rows of the training sample for each list, rows of a mini-batch for each list, rounds, rows that tune.
MAX_LISTS, TRAIN_ROWS, BATCH_ROWS, ROUNDS, TUNE_QUERIES = 4096, 256, 64, 12, 128
#: Rows and queries that meet at once in a batch search. They only steer the cost.
KEY_ROWS, KEY_QUERIES = 50_000, 2048


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def as_matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(centroids: np.ndarray, dimension: int):
    """The list of each vector, null for one that has no direction."""

    @F.pandas_udf("int")
    def assign(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            out = np.full(len(vectors), -1)
            fits = [i for i, v in enumerate(vectors) if v is not None and len(v) == dimension]
            if fits:
                x = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in fits])
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                out[np.asarray(fits)[good]] = (x[good] @ centroids.T).argmax(1) if good.any() else 0
            yield pd.Series(out, dtype="Int64").where(out >= 0)

    return assign


def train(sample: DataFrame, n: int, lists: int, dimension: int, seed: int) -> np.ndarray:
    """Spherical k-means over mini-batches of ``sample`` (id, vector), which has ``n`` rows.

    Rounds take turns through the sample by a hash of the id. A centroid moves to the mean of all it has been given, so
    that later rounds move it less. Tasks send the sums of their rows, which Spark adds up: lists * dimension numbers.
    """
    first = sample.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(4 * lists).collect()  # bounded by MAX_LISTS
    start = np.unique(unit_rows(np.array([r["vector"] for r in first], np.float64)), axis=0)
    centroids = start[np.random.default_rng(seed).permutation(len(start))[:lists]]
    given = np.zeros(len(centroids))
    turns = max(1, n // (BATCH_ROWS * lists))

    def sums_of(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centroids), dimension + 1))  # the last column counts
            for batch in batches:
                x = unit_rows(as_matrix(batch.column(0)))
                np.add.at(total, (x @ centroids.T).argmax(1), np.hstack([x, np.ones((len(x), 1))]))
            cell = np.flatnonzero(total.any(1))[:, None] * (dimension + 1) + np.arange(dimension + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(total.ravel()[cell.ravel()])], names=["cell", "x"])

        return run

    for turn in range(ROUNDS):
        batch = sample.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(turns)) == turn % turns).select("vector")
        cells = batch.mapInArrow(sums_of(centroids), "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(len(centroids) * (dimension + 1))
        for cell, x in cells:
            total[cell] = x
        total = total.reshape(len(centroids), dimension + 1)
        counts = total[:, dimension]
        given += counts
        step = np.divide(counts, given, out=np.zeros_like(given), where=given > 0)[:, None]
        means = np.divide(total[:, :dimension], counts[:, None], out=centroids.copy(), where=counts[:, None] > 0)
        centroids = unit_rows(centroids + step * (means - centroids))
    return centroids


def half_floats(dimension: int):
    """A vector as 16-bit floats, little-endian."""

    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, "<f2").tobytes())

    return encode


def half_cosine(query: Sequence[float]):
    """The cosine of a query and vectors of 16-bit floats."""
    q = np.asarray(query, np.float64)

    @F.pandas_udf("double")
    def score(codes: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(codes), "<f2").astype(np.float64).reshape(len(codes), -1)
        norms = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())
        return pd.Series(np.divide(x @ q, norms, out=np.full(len(x), -2.0), where=norms > 0))

    return score


def build(rows: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, recall: float = 0.95, k: int = 10, seed: int = 7) -> None:
    """Write the index of ``rows`` at ``path``; an unfinished one there is replaced. ``lists`` is the root of the rows by default."""
    spark = rows.sparkSession
    if exists(spark, f"{path}/about/_SUCCESS"):
        raise FileExistsError(path)
    renamed = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("vector"), *[F.col(f"`{c}`") for c in rows.columns if c not in (id_col, vector_col)])
    v = F.col("vector")
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    about = renamed.where(sound).agg(F.count("*").alias("n"), F.max(F.size(v)).alias("dimension")).first()
    n, dimension = about["n"], about["dimension"] or 0
    lists = max(1, min(MAX_LISTS, lists or round(n**0.5)))
    fit = renamed.where(sound & (F.size(v) == dimension)).select("id", "vector")
    share = min(1.0, TRAIN_ROWS * lists / max(n, 1))
    sampled = fit.where(F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sampled.write.mode("overwrite").parquet(f"{path}/sample")
    sample = spark.read.schema(sampled.schema).parquet(f"{path}/sample")
    in_sample = sample.count()
    centroids = train(sample, in_sample, lists, dimension, seed) if in_sample else np.zeros((1, max(dimension, 1)))

    assigned = renamed.where(sound).withColumn("list", nearest(centroids, dimension)(F.col("vector"))).where("list IS NOT NULL")
    # partitions are made by size, so a list of many rows is several files and tasks
    assigned.hint("rebalance", F.col("list")).write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    whole = spark.read.schema(assigned.schema).parquet(f"{path}/vectors")
    codes = whole.select("id", "list", sign_words(F.col("vector"), dimension).alias("signs"), half_floats(dimension)(F.col("vector")).alias("half"))
    codes.hint("rebalance", F.col("list")).write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")
    sizes = {r["list"]: r["n"] for r in whole.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
    table = [(i, c.tolist(), sizes.get(i, 0)) for i, c in enumerate(centroids)]
    spark.createDataFrame(table, "list int, centroid array<double>, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    schema = assigned.schema.json()
    probes = _probes(VectorIndex(spark, path, dimension, n, 1, schema), sample, k, recall) if in_sample else 1
    spark.createDataFrame([(dimension, n, probes, schema)], "dimension int, n long, probes int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def _probes(index: VectorIndex, sample: DataFrame, k: int, recall: float) -> int:
    """How many lists give ``recall`` of the k exact neighbours of some rows, by where those neighbours lie."""
    queries = sample.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(TUNE_QUERIES)
    found = index.top_k_each(queries.select(F.col("id").alias("query_id"), "vector"), k, probes=None)
    vectors = {r["id"]: r["vector"] for r in queries.collect()}
    ranks = []
    for r in found.collect():  # TUNE_QUERIES * k rows
        order = index.order_of(vectors[r["query_id"]])
        ranks.append(int(np.flatnonzero(order == r["list"])[0]) + 1)
    return int(np.quantile(ranks, recall, method="higher")) if ranks else 1


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    dimension: int
    n: int
    probes: int
    schema: str

    @cached_property
    def centroids(self) -> np.ndarray:
        return np.array([r["centroid"] for r in self._sizes().orderBy("list").collect()])  # at most MAX_LISTS rows

    def _sizes(self) -> DataFrame:
        return self.spark.read.schema("list int, centroid array<double>, n long").parquet(f"{self.path}/centroids")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/vectors")

    def codes(self) -> DataFrame:
        return self.spark.read.schema("id long, signs array<bigint>, half binary, list int").parquet(f"{self.path}/codes")

    def order_of(self, query: Sequence[float]) -> np.ndarray:
        """All lists, the nearest first."""
        return np.argsort(-(self.centroids @ np.asarray(query, np.float64)), kind="stable")

    def _probed(self, table: DataFrame, query: Sequence[float], probes: int | None) -> DataFrame:
        return table if probes is None else table.where(F.col("list").isin(*self.order_of(query)[:probes].tolist()))

    def candidates(self, query: Sequence[float], n: int, probes: int | None = 0, code: str = "signs") -> DataFrame:
        """The rows of the n nearest codes in the probed lists; ``code`` is ``signs`` or ``half``.

        ``probes`` is the index's own by default, None for all lists. Only codes are read to find them.
        """
        if n <= 0 or len(query) != self.dimension:
            raise ValueError(f"n must be positive and the query have {self.dimension} numbers")
        probes = self.probes if probes == 0 else probes
        codes = self._probed(self.codes(), query, probes)
        if code == "signs":
            near = codes.select("id", hamming(F.col("signs"), signs_of(query)).alias("far"))
        else:
            near = codes.select("id", (-half_cosine(query)(F.col("half"))).alias("far"))
        near = near.orderBy("far", "id").limit(n).select("id")
        return self._probed(self.vectors(), query, probes).join(F.broadcast(near), "id", "left_semi").drop("list")  # n ids

    def top_k(self, query: Sequence[float], k: int, probes: int | None = 0, candidates: int = 100, code: str = "signs") -> DataFrame:
        """The k best rows: candidates by their codes, ordered again by exact cosine."""
        return top_k(self.candidates(query, max(k, candidates), probes, code), query, k, "id", "vector")

    def top_k_each(self, queries: DataFrame, k: int, probes: int | None = 0) -> DataFrame:
        """(query_id, id, list, similarity_score, rank from 1) of each query (query_id, vector) in the lists that it probes.

        Queries and rows of a list are dealt over keys of bounded numbers of both. In a task the queries of a key come
        first and its rows stream by; k rows for each query are what goes on.
        """
        probes = self.probes if probes == 0 else probes
        probes = len(self.centroids) if probes is None else min(probes, len(self.centroids))
        asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<float>").alias("vector"), F.explode(nearest_lists(self.centroids, self.dimension, probes)(F.col("vector"))).alias("list"))
        loads = asked.groupBy("list").agg(F.count("*").alias("asked"))
        rows = self.vectors().select("list", "id", "vector")
        sizes = self._sizes().join(loads, "list").select("list", F.ceil(F.col("n") / KEY_ROWS).cast("int").alias("s"), F.ceil(F.col("asked") / KEY_QUERIES).cast("int").alias("t")).where("s > 0")
        sizes = F.broadcast(sizes)  # at most MAX_LISTS rows
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(sizes, "list").select("list", every("s").alias("s"), F.pmod(F.xxhash64("query_id"), F.col("t")).cast("int").alias("t"), F.lit(0).alias("kind"), F.col("query_id").alias("id"), "vector")
        right = rows.join(sizes, "list").select("list", F.pmod(F.xxhash64("id"), F.col("s")).cast("int").alias("s"), every("t").alias("t"), F.lit(1).alias("kind"), "id", "vector")
        keyed = left.unionByName(right).repartition("list", "s", "t").sortWithinPartitions("list", "s", "t", "kind")
        found = keyed.mapInArrow(best_of_keys(k), "query_id long, id long, list int, similarity_score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity_score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def read(spark: SparkSession, path: str) -> VectorIndex:
    if not exists(spark, f"{path}/about/_SUCCESS"):
        raise FileNotFoundError(f"{path} is no finished index")
    about = spark.read.parquet(f"{path}/about").first()
    return VectorIndex(spark, path, about["dimension"], about["n"], about["probes"], about["schema"])


def nearest_lists(centroids: np.ndarray, dimension: int, probes: int):
    """The ``probes`` nearest lists of each vector; none for one without a direction."""

    @F.pandas_udf("array<int>")
    def lists(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            x = None if v is None or len(v) != dimension else np.asarray(v, np.float64)
            if x is None or not np.isfinite(x).all() or not x.any():
                out.append([])
            else:
                out.append(np.argsort(-(centroids @ x), kind="stable")[:probes].astype(np.int32))
        return pd.Series(out)

    return lists


def best_of_keys(k: int):
    """The k best rows of each query of a key, for rows sorted by key with the queries before the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, best = None, [], [], None

        def emit() -> Iterator[pa.RecordBatch]:
            if best is not None:
                at, row, score = best
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)[at]), pa.array(row), pa.array(np.full(len(at), key[0], np.int32)), pa.array(score)], names=["query_id", "id", "list", "similarity_score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "s", "t", "kind")], 1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if tuple(keys[a][:3]) != key:
                    yield from emit()
                    key, ids, parts, best = tuple(keys[a][:3]), [], [], None
                x = unit_rows(as_matrix(batch.column("vector").slice(a, b - a)))
                own = batch.column("id").slice(a, b - a).to_numpy()
                if keys[a][3] == 0:
                    ids.append(own)
                    parts.append(x)
                    continue
                for c in range(0, b - a if parts else 0, 4096):
                    best = merged(best, np.concatenate(parts), x[c : c + 4096], own[c : c + 4096], k)
        yield from emit()

    return run


def merged(best: tuple | None, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best so far of each query, with those of more rows."""
    scores = np.round(queries @ rows.T, DIGITS) + 0.0
    if best is not None:  # what is worse than k known rows needn't be sorted
        at, _, known = best
        least = np.full(len(queries), -np.inf)
        full = np.bincount(at, minlength=len(queries)) >= k
        np.minimum.at(worst := np.full(len(queries), np.inf), at, known)
        least[full] = worst[full]
        q, j = np.nonzero(scores >= least[:, None])
        q, row, score = np.concatenate([at, q]), np.concatenate([best[1], ids[j]]), np.concatenate([known, scores[q, j]])
    else:
        top = min(k, len(rows))
        least = -np.partition(-scores, top - 1, axis=1)[:, top - 1]
        q, j = np.nonzero(scores >= least[:, None])
        row, score = ids[j], scores[q, j]
    order = np.lexsort((row, -score, q))
    q, row, score = q[order], row[order], score[order]
    begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    kept = np.arange(len(q)) - np.repeat(begins, np.diff([*begins, len(q)])) < k
    return q[kept], row[kept], score[kept]
