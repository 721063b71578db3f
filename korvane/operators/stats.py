"""Aggregates over chunk tables, embeddings and grades. All combine before their shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import bad_vectors

DIGITS = 6


def table_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents, and mean tokens to two digits (0 of an empty table)."""
    mean = F.coalesce(F.round(F.avg("token_count"), 2), F.lit(0.0))
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("source_document").alias("n_documents"), mean.alias("avg_tokens"))


def document_profile(chunks: DataFrame, top: int | None = None) -> DataFrame:
    """(source_document, n_chunks, tokens, avg_tokens), the largest first; all unless ``top`` is given."""
    rows = chunks.groupBy("source_document").agg(
        F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"), F.round(F.avg("token_count"), 2).alias("avg_tokens")
    )
    return rows.orderBy(F.desc("n_chunks"), "source_document").limit(top) if top else rows


def embedding_dims(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    return rows.groupBy(F.size(vector_col).cast("long").alias("dims")).agg(F.count("*").alias("n"))


def batch_report(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, tokens, and mean chunks of a document (0 if there is none)."""
    each = chunks.groupBy("source_document").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    return each.agg(
        F.count("*").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.round(F.avg("n"), DIGITS), F.lit(0.0)).alias("chunks_per_document"),
    )


def completeness(rows: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """One row: filled fields over all fields that count; an optional field counts only where it is present."""
    filled = lambda c: F.col(c).isNotNull() & (F.btrim(F.col(c).cast("string")) != "")
    full = sum((F.when(filled(c), 1).otherwise(0) for c in (*required, *optional)), F.lit(0))
    all_ = F.lit(len(required)) + sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in optional), F.lit(0))
    return rows.agg(F.sum(full).alias("complete"), F.sum(all_).alias("total")).select("complete", "total", F.round(F.try_divide("complete", "total"), DIGITS).alias("ratio"))


def cache_savings(hits: Column, misses: Column, tokens_each: int) -> tuple[Column, Column]:
    """Share of hits (0 without a request), and the tokens that they saved."""
    return F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0)), hits * tokens_each


def token_savings(hits: Column, consumed: Column, tokens_each: int = 5000) -> Column:
    """The share of all tokens that hits of a cache saved; 0 without a hit."""
    return F.coalesce(F.try_divide(hits * tokens_each, consumed + hits * tokens_each), F.lit(0.0))


def index_validation(files: DataFrame, rows: DataFrame, dimension: int, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """One row: files, rows, files without a row, rows with a bad vector, and whether all is well."""
    missing = files.join(rows.select(id_col), id_col, "left_anti").agg(F.count("*").alias("n_missing"))
    counts = files.agg(F.count("*").alias("n_files")).join(rows.agg(F.count("*").alias("n_rows")))
    bad = bad_vectors(rows, dimension, vector_col).agg(F.count("*").alias("n_bad"))
    one = counts.join(missing).join(bad)  # one row each
    return one.withColumn("valid", (F.col("n_files") == F.col("n_rows")) & (F.col("n_missing") == 0) & (F.col("n_bad") == 0))


def table_size_mb(rows: DataFrame) -> float:
    """Megabytes of the files of a table that is read from files, to two digits."""
    files = rows.select("_metadata.file_path", "_metadata.file_size").distinct()
    return round((files.agg(F.sum("file_size")).first()[0] or 0) / 2**20, 2)


def store_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: files of a store and their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def match_counts(located: DataFrame, matched_col: str = "matched") -> DataFrame:
    """One row: chunks that were found in their document, and those that weren't."""
    found = F.coalesce(F.col(matched_col), F.lit(False))
    return located.agg(F.count_if(found).alias("n_matched"), F.count_if(~found).alias("n_unmatched"))


def total_duration(videos: DataFrame, seconds_col: str = "duration") -> DataFrame:
    """One row: videos, their seconds, and these as whole hours and minutes."""
    total = videos.agg(F.count("*").alias("n_videos"), F.coalesce(F.sum(seconds_col), F.lit(0)).alias("seconds"))
    return total.withColumn("hours", F.floor(F.col("seconds") / 3600)).withColumn("minutes", F.floor(F.col("seconds") % 3600 / 60))


def duration_seconds(starts: Column, ends: Column) -> Column:
    """Seconds between two times, to two digits; null while one is open."""
    return F.round(ends.cast("timestamp").cast("double") - starts.cast("timestamp").cast("double"), 2)


def index_stats(results: DataFrame, status_col: str = "status") -> DataFrame:
    """One row: successes, failures and skips, and the share of successes of what was tried."""
    n = lambda s: F.count_if(F.col(status_col) == s)
    counts = results.agg(n("ok").alias("n_ok"), n("failed").alias("n_failed"), n("skipped").alias("n_skipped"))
    return counts.withColumn("success_rate", F.coalesce(F.round(F.try_divide(100.0 * F.col("n_ok"), F.col("n_ok") + F.col("n_failed")), 2), F.lit(0.0)))


def retrieval_quality(grades: DataFrame, key: str, grade_col: str = "grade", threshold: float = 0.5) -> DataFrame:
    """For each query: mean of all grades, how many are kept, and the confidence of an answer from them.

    A grade that can't be read counts as 0.5. The confidence is 0.7 of the kept mean and 0.3 of how near to five are
    kept; 0 if none is.
    """
    grade = F.coalesce(F.col(grade_col).try_cast("double"), F.lit(0.5))
    sums = grades.select(key, grade.alias("_g")).groupBy(key).agg(
        F.round(F.avg("_g"), DIGITS).alias("quality"), F.count_if(F.col("_g") >= threshold).alias("n_kept"), F.avg(F.when(F.col("_g") >= threshold, F.col("_g"))).alias("_mean")
    )
    return sums.select(key, "quality", "n_kept", answer_confidence(F.col("_mean"), F.col("n_kept")).alias("confidence"))


def answer_confidence(mean: Column, n: Column) -> Column:
    return F.when(n > 0, F.round(0.7 * mean + 0.3 * F.least(n / 5.0, F.lit(1.0)), DIGITS)).otherwise(F.lit(0.0))


def catalog(parents: DataFrame, key: str, order: str, start: str, end: str, speakers: str, title: str) -> DataFrame:
    """For each video: parts, duration (end of the last less start of the first), speakers, and the first title."""
    return parents.groupBy(key).agg(
        F.count("*").alias("n_parts"), (F.max_by(end, order) - F.min_by(start, order)).alias("duration"),
        F.array_join(F.array_sort(F.collect_set(speakers)), ",").alias("speakers"), F.min_by(title, order).alias("title"),
    )
