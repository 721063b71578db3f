"""What the registered queries share: the registry itself, and the tables in the shapes that operators take."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions.models import letter_embedding
from korvane.functions.text import token_count
from korvane.session import exists, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: ``documents`` as a table of chunks, in SQL.
CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, source AS source_document, lang AS chapter_title, coalesce(text, '') AS chunk_text,
         CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS token_count
  FROM documents
)"""
#: The words of each document, in SQL.
WORDS = r"""words AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows if there is one."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str, tag: str, ready: str, make: Callable[[DataFrame, str], None]) -> str:
    """The path of what ``make`` derives from a table, for the whole application; it is made again if the table's files change.

    ``ready`` is what lies there once it is whole.
    """
    rows = table(spark, sf_dir, name)
    files = rows.groupBy("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").count().collect()  # a row for each file
    version = hashlib.sha256(repr(sorted(map(tuple, files))).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/korvane/{spark.sparkContext.applicationId}/{tag}-{version}"
    if not exists(spark, f"{path}/{ready}"):
        make(rows, path)
    return path


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunks``, stored with their embeddings, so that a search reads these."""
    path = stored(spark, sf_dir, "documents", "chunks", "_SUCCESS", lambda _, to: chunks(spark, sf_dir).write.mode("overwrite").parquet(to))
    return spark.read.parquet(path)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a table of chunks; the embedding counts letters."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_document"), F.col("lang").alias("chapter_title"), text.alias("chunk_text"),
        token_count(text).cast("long").alias("token_count"), letter_embedding(text).alias("embedding"),
    )
