"""Search with models that are trained on the tables themselves: embeddings of ``documents``, a reranker from ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions.models import tokens_of
from korvane.operators import embedding_model, ranking, search, vector_index
from korvane.plans.base import query, stored, table
from korvane.plans.retrieval import K, TEXT
from korvane.session import small_batches

#: Labelled documents that the ranker meets, about; words of a benchmark item that make a query; each so many items are held out.
FIT_DOCS, QUERY_WORDS, HELD_OUT = 4000, 6, 5


def _model(spark: SparkSession, sf_dir: str) -> embedding_model.EmbeddingModel:
    """The embedding learned from ``documents``, by the first query that needs it."""

    def make(docs: DataFrame, path: str) -> None:
        embedding_model.fit(docs, work_dir=f"{path}-words").write(spark, path)

    return embedding_model.read(spark, stored(spark, sf_dir, "documents", "svd", "_SUCCESS", make))


def _embedded(spark: SparkSession, sf_dir: str, model: embedding_model.EmbeddingModel) -> DataFrame:
    """``documents`` as chunks with learned embeddings, stored once."""

    def make(docs: DataFrame, path: str) -> None:
        text = F.coalesce("text", F.lit(""))
        rows = small_batches(docs).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_document"), F.col("lang").alias("chapter_title"), text.alias("chunk_text"), model(text).alias("embedding"))
        rows.write.mode("overwrite").parquet(path)

    return spark.read.parquet(stored(spark, sf_dir, "documents", "svd-chunks", "_SUCCESS", make))


@query()
def search_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple strategy with learned embeddings."""
    model = _model(spark, sf_dir)
    found = search.search("simple", _embedded(spark, sf_dir, model), TEXT, K, embed=model)
    return found.select("chunk_id", "source_document", "chapter_title", "similarity_score")


@query()
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest documents of each whose id is divisible by 50, by learned embeddings and an index of them."""
    rows = _embedded(spark, sf_dir, _model(spark, sf_dir)).select("chunk_id", "embedding")
    path = stored(spark, sf_dir, "documents", "svd-index", "about/_SUCCESS", lambda _, to: vector_index.build(rows, to, "chunk_id"))
    queries = rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vector_index.read(spark, path).top_k_each(queries, K)
    return found.select("query_id", F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "similarity_score")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id, query, text, grade, held_out): labelled documents that share a word with the first words of an item.

    A document of good quality is graded 1, and 3 if it holds the words that follow in the item, which the query doesn't
    show. Items and documents are both held out, so that neither of a tested pair takes part in training.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = labels.count()  # from the files' footers
    sampled = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(min(1.0, FIT_DOCS / max(1, rows)) * (1 << 20)))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sampled, "doc_id")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    part = lambda a: F.array_join(F.slice(words, a, QUERY_WORDS), " ")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), part(1).alias("query"), part(1 + QUERY_WORDS).alias("rest"))
    of_doc = docs.select("doc_id", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("w"))
    of_item = items.select("query_id", F.explode(F.array_distinct(tokens_of(F.col("query")))).alias("w"))
    held_out = lambda c, n: F.pmod(F.xxhash64(c, F.lit(6)), F.lit(n)) == 0
    shared = of_item.join(of_doc, "w").select("query_id", F.col("doc_id").alias("id")).distinct()
    shared = shared.withColumn("held_out", held_out("query_id", HELD_OUT)).where(F.col("held_out") == held_out("id", 2))
    known = ranking.some_candidates(shared).join(items, "query_id").join(docs.withColumnRenamed("doc_id", "id"), "id")
    holds = (F.col("rest") != "") & F.contains(F.col("text"), F.col("rest"))
    grade = F.when(F.col("quality") != 1, 0).when(holds, 3).otherwise(1)
    return known.select("query_id", "id", "query", "text", grade.alias("grade"), "held_out")


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[ranking.Ranker, DataFrame]:
    """The ranker, and all judged pairs with their features."""

    def make(_: DataFrame, path: str) -> None:
        rows = judged(spark, sf_dir).withColumn("x", ranking.features(F.col("query"), F.col("text")))
        rows.withColumn("overlap", F.get("x", F.lit(0))).drop("text").write.mode("overwrite").parquet(path)

    rows = spark.read.parquet(stored(spark, sf_dir, "labels", "judged", "_SUCCESS", make))
    return ranking.fit(rows.where("NOT held_out")), rows


@query()
def rerank_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rerank strategy with learned embeddings and the trained ranker."""
    model = _model(spark, sf_dir)
    ranker, _ = _ranked(spark, sf_dir)
    found = search.search("rerank", _embedded(spark, sf_dir, model), TEXT, K, embed=model, score=ranker)
    return found.select("chunk_id", "source_document", "chapter_title", "similarity_score", "rerank_score")


@query()
def ranker_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each held-out item how well the ranker and shared words alone order its documents, over all of them."""
    ranker, rows = _ranked(spark, sf_dir)
    tested = rows.where("held_out")
    out = tested.select("query_id").distinct()
    for name, score in (("learned", ranker.score_of(F.col("x"))), ("shared", F.col("overlap"))):
        scored = tested.select("query_id", "id", "grade", score.alias("score"))
        gains, pairs = ranking.ndcg(scored, ranking.CANDIDATES), ranking.ordered_pairs(scored)
        out = out.join(gains.select("query_id", F.round("ndcg", 6).alias(f"{name}_ndcg")), "query_id").join(pairs.select("query_id", F.round("share", 6).alias(f"{name}_pairs")), "query_id")
    return out
