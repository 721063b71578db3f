"""A linear reranker trained on pairs: of two texts judged for one query, the better one should score higher.

Features of a query and a text are column expressions (shared words, saturated frequencies as in BM25, the place of the
first match, the whole query as a phrase, different words, length), so a trained ranker is a Scorer that runs in the JVM.
Weights minimise the logistic loss of the differences of all pairs with different grades, by Newton's method: a step is one
Spark job in which every query's texts, CANDIDATES of them at most, give their gradient and curvature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.functions.models import tokens_of
from korvane.session import unused

FEATURES = ("shared", "saturated", "early", "phrase", "different", "length")
#: Texts of a query that take part in training, steps, weight decay, and the words of a text of middling length.
CANDIDATES, STEPS, DECAY, MEAN_WORDS = 64, 8, 1e-3, 300
K1, B = 1.5, 0.75


def features(query: Column, text: Column) -> Column:
    """The features of a query and a text, an array of doubles in the order of FEATURES; zeros for a query without words."""

    def of(words: Column, own: Column) -> Column:
        n = F.size(words)
        times = F.transform(own, lambda w: F.size(F.filter(words, lambda x: x == w)).cast("double"))
        saturated = F.transform(times, lambda tf: tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / MEAN_WORDS)))
        places = F.filter(F.transform(own, lambda w: F.array_position(words, w)), lambda p: p > 0)
        mean = lambda x: F.coalesce(F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, y: s + y), F.size(own)), F.lit(0.0))
        return F.array(
            F.coalesce(F.try_divide(F.size(F.array_intersect(own, words)).cast("double"), F.size(own)), F.lit(0.0)),
            mean(saturated),
            F.coalesce(1.0 / F.array_min(places), F.lit(0.0)),
            F.when((F.trim(query) != "") & F.contains(F.lower(text), F.lower(F.trim(query))), 1.0).otherwise(0.0),
            F.coalesce(F.try_divide(F.size(F.array_distinct(words)).cast("double"), n), F.lit(0.0)),
            F.log1p(n.cast("double")) / 10.0,
        )

    # transforms over arrays of one, so that words are made once for all features
    pair = F.array(F.struct(tokens_of(text).alias("w"), F.array_distinct(tokens_of(query)).alias("q")))
    return F.get(F.transform(pair, lambda p: of(p["w"], p["q"])), F.lit(0))


@dataclass(frozen=True)
class Ranker:
    """Weights of the features; their means and deviations are part of them."""

    weights: tuple[float, ...]

    def score_of(self, vector: Column) -> Column:
        weights = F.array(*map(F.lit, self.weights))
        return F.aggregate(F.zip_with(vector, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)

    def __call__(self, query: str, text: Column) -> Column:
        """The score of a text for a query: a Scorer."""
        return self.score_of(features(F.lit(query), text))


def some_candidates(judged: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    """Of each query (query_id, id) so many texts by a hash; also applied in each task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.xxhash64("query_id", "id"), "id")
    place = unused(judged, "_place")
    return judged.withColumn(place, F.row_number().over(order)).where(F.col(place) <= candidates).drop(place)


def fit(judged: DataFrame, steps: int = STEPS, decay: float = DECAY) -> Ranker:
    """Train on rows (query_id, id, x, grade) with the features x; a query's are as many as ``some_candidates`` leaves."""
    n = len(FEATURES)
    stats = judged.select(*[F.get("x", F.lit(i)).alias(f) for i, f in enumerate(FEATURES)]).agg(*[F.stddev_pop(f).alias(f) for f in FEATURES]).first()
    scale = np.array([1 / s if s else 0.0 for s in (stats[f] for f in FEATURES)])
    weights = np.zeros(n)

    def step_of(weights: np.ndarray):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("id")
            x, grade = np.stack(rows["x"]) * scale, rows["grade"].to_numpy(float)
            better, worse = np.nonzero(grade[:, None] > grade)
            d = x[better] - x[worse]
            miss = 1 / (1 + np.exp(np.clip(d @ weights, -50, 50)))
            gradient, curvature = miss @ d, (d * (miss * (1 - miss))[:, None]).T @ d
            return pd.DataFrame({"cell": np.arange(n + n * n + 1), "v": np.concatenate([gradient, curvature.ravel(), [len(d)]])})

        return run

    for _ in range(steps):
        sums = judged.select("query_id", "id", "x", "grade").groupBy("query_id").applyInPandas(step_of(weights), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(n + n * n + 1)
        for cell, v in sums:
            total[cell] = v
        pairs = max(total[-1], 1)
        gradient, curvature = total[:n] / pairs - decay * weights, total[n:-1].reshape(n, n) / pairs + decay * np.eye(n)
        weights = weights + np.linalg.solve(curvature, gradient)
    return Ranker(tuple(float(round(w, 9)) for w in weights * scale))


def ndcg(scored: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) of rows (query_id, id, score, grade): gains 2^grade - 1, ties by id; 0 where no text has a grade."""
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1)
    found = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))
    sums = [scored.select("query_id", "grade", place.alias("place")).where(F.col("place") <= k).groupBy("query_id").agg(F.sum(gain).alias(name)) for place, name in ((found, "dcg"), (ideal, "most"))]
    return sums[0].join(sums[1], "query_id").select("query_id", F.coalesce(F.try_divide("dcg", "most"), F.lit(0.0)).alias("ndcg"))


def ordered_pairs(scored: DataFrame) -> DataFrame:
    """(query_id, share): of the pairs of a graded text and one of grade 0, how many the score has in order; ties are half.

    By the ranks of the graded ones, so that no pair is made; null for a query without such a pair.
    """
    below = F.rank().over(Window.partitionBy("query_id").orderBy("score"))
    equal = F.count("*").over(Window.partitionBy("query_id", "score"))
    ranked = scored.select("query_id", (F.col("grade") > 0).alias("good"), (below + (equal - 1) / 2).alias("place"))
    sums = ranked.groupBy("query_id").agg(F.sum(F.when(F.col("good"), F.col("place"))).alias("places"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    return sums.select("query_id", F.try_divide(F.col("places") - F.col("good") * (F.col("good") + 1) / 2, F.col("good") * F.col("bad")).alias("share"))
