"""Idempotent writes: insert what is absent, upsert, what is left to do, tables with metadata beside them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from korvane.session import exists, unused

from .validation import table_name


def absent(incoming: DataFrame, existing: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows to insert: the first of each key, unless the table has the key. Null keys are never inserted."""
    i = unused(incoming, "_i")
    first = incoming.where(F.col(key).isNotNull()).withColumn(i, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(i) == 1).drop(i)
    return first.join(existing.select(key), key, "left_anti").select(*incoming.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The table after incoming rows have replaced those of their key; ``incoming`` has each key once."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key), key, "left_anti")


def append_absent(incoming: DataFrame, path: str, key: str, order: Sequence[str]) -> None:
    """Append to a Parquet table what it lacks; it is created if it isn't there."""
    spark = incoming.sparkSession
    existing = read_or_empty(spark, path, incoming)
    absent(incoming, existing, key, order).write.mode("append").parquet(path)


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path) if exists(spark, path) else like.limit(0)


META = ("embedding_model", "embedding_dimension", "provider_type", "total_chunks", "generated_at")


#: Where Spark keeps its schema in a footer, and where the key-values stand in it: with a column, which every file has.
_ROW_METADATA, _KEY = b"org.apache.spark.sql.parquet.row.metadata", "embeddings"


def write_embeddings(rows: DataFrame, path: str, meta: Mapping[str, str]) -> None:
    """Vectors under ``path``/data with their metadata in the footer of every file, and as one row under ``path``/_meta; all keys are needed.

    Spark writes a column's metadata into the footers, so tasks need nothing but the usual writer.
    """
    lacking = [k for k in META if k not in meta]
    if lacking:
        raise ValueError(f"metadata lacks {', '.join(lacking)}")
    if rows.isEmpty():
        raise AssertionError("there is nothing to write")
    values = {k: str(meta[k]) for k in META}
    first = rows.columns[0]
    marked = rows.withMetadata(first, {**rows.schema[first].metadata, _KEY: values})
    marked.write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/data")
    one = rows.sparkSession.createDataFrame([tuple(values[k] for k in META)], ", ".join(f"{k} string" for k in META))
    one.coalesce(1).write.mode("overwrite").parquet(f"{path}/_meta")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, embedding_model, ...): the key-values in the footer of each Parquet file below ``path``, null where one lacks.

    Spark lists the files; tasks read their tails alone. The store must be one that pyarrow opens.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(f, *footer_values(f)) for f in part["file"]], columns=["file", *META])

    return files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "file string, " + ", ".join(f"{k} string" for k in META))


def footer_values(file: str) -> tuple[str | None, ...]:
    """The values of META in one file's footer."""
    store, name = pa_fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
    with store.open_input_file(name) as tail:
        found = (pq.read_metadata(tail).metadata or {}).get(_ROW_METADATA)
    fields = json.loads(found)["fields"] if found else []
    values = next((f["metadata"][_KEY] for f in fields if _KEY in f["metadata"]), {})
    return tuple(values.get(k) for k in META)


def disagreeing(found: DataFrame) -> DataFrame:
    """The files of ``footers`` whose values aren't those that most files have, or that lack one; ties go to the smaller values."""
    values = F.struct(*META)
    counts = found.groupBy(values.alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(1)
    most = counts.select(F.col("v").alias("most"))
    lacks = reduce(or_, [F.col(k).isNull() for k in META[:4]])
    return found.join(F.broadcast(most)).where(~values.eqNullSafe(F.col("most")) | lacks).drop("most")  # one row


def read_embeddings(spark: SparkSession, path: str, dimension: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The table and its metadata, from the footers; a missing key and another dimension than expected are errors.

    The schema that Spark reads from a footer has the values, in whatever store the files are. That all files agree is what
    ``disagreeing`` tells.
    """
    rows = spark.read.parquet(f"{path}/data")
    meta = next((f.metadata[_KEY] for f in rows.schema if _KEY in f.metadata), {})
    lacking = [k for k in META[:4] if meta.get(k) is None]
    if lacking:
        raise ValueError(f"metadata lacks {', '.join(lacking)}")
    if dimension is not None and int(meta["embedding_dimension"]) != dimension:
        raise ValueError(f"vectors have {meta['embedding_dimension']} numbers, not {dimension}")
    return rows, dict(meta)


def resumed(work: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of all work: those that are stored, and those that ``compute`` makes of the rest and are stored now.

    A content-addressed store is the same with a hash of the content as the key. ``work`` has each key once.
    """
    spark = work.sparkSession
    made = compute(work if not exists(spark, path) else remaining(work, spark.read.parquet(path), key))
    made.write.mode("append").parquet(path)
    return spark.read.schema(made.schema).parquet(path).join(work.select(key), key, "left_semi")


def append_messages(messages: DataFrame, path: str) -> None:
    """Append to a table of messages (conv_id, turn, ...) those turns that it lacks."""
    new = messages.join(read_or_empty(messages.sparkSession, path, messages).select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    new.dropDuplicates(["conv_id", "turn"]).write.mode("append").parquet(path)


def touched(rows: DataFrame, at: str | None = None) -> DataFrame:
    """``rows`` with ``updated_at`` of now (or a given time), as every write of a row sets it."""
    return rows.withColumn("updated_at", F.lit(at).cast("timestamp") if at else F.current_timestamp())


def create_table(spark: SparkSession, name: str, schema: str) -> bool:
    """An empty Parquet table, unless there is one of that name; whether it was made."""
    if spark.catalog.tableExists(name):
        return False
    spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)
    return True


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table_name(name)}")


def clear_table(spark: SparkSession, name: str) -> int:
    """Delete all rows; how many there were."""
    n = spark.table(name).count()
    spark.sql(f"TRUNCATE TABLE {table_name(name)}")
    return n


def write_counted(rows: DataFrame, path: str, least: int = 1) -> int:
    """Write a table and count what is there; fewer rows than ``least``, or than were given, are an error."""
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
    n = rows.sparkSession.read.parquet(path).count()
    if n < least or n != seen.get["n"]:
        raise ValueError(f"{path} has {n} rows of {seen.get['n']}, at least {least} are needed")
    return n


def write_report(report: DataFrame, path: str) -> None:
    """A coverage report as JSON, a document a line."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)
