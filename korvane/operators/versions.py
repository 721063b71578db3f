"""Conversations at a version: numbered changes of each thread, snapshots in between, and the state at any version.

Tables under one folder: ``changes`` (thread, version, message, op, role, text), append-only; ``snapshots``, the messages of
some threads at some of their versions; ``marks`` (thread, version), written after them, so that a snapshot counts once it
is whole. An ``op`` is ``put``, which adds a message or replaces it, or ``remove``. Versions of a thread are 1, 2, ...; 0 is
the empty thread. Restoring reads the last snapshot before a version and the changes since. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korvane.session import exists

CHANGES = "thread long, version long, message long, op string, role string, text string"
SNAPSHOTS = "thread long, at long, message long, role string, text string"
#: A snapshot of a thread for so many changes.
EVERY = 32


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else spark.createDataFrame([], schema)


def numbered(changes: DataFrame, last: DataFrame, order: list[str]) -> DataFrame:
    """CHANGES of changes without a version, which go on from ``last`` (thread, last)."""
    number = F.row_number().over(Window.partitionBy("thread").orderBy(*order))
    known = changes.join(last, "thread", "left").withColumn("version", F.coalesce("last", F.lit(0)) + number)
    return known.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in CHANGES.split(", ")])


def append_changes(changes: DataFrame, path: str, order: list[str]) -> None:
    """Number and store changes (thread, message, op, role, text, and what ``order`` names)."""
    spark = changes.sparkSession
    mine = _table(spark, path, "changes", CHANGES).join(changes.select("thread").distinct(), "thread", "left_semi")
    numbered(changes, mine.groupBy("thread").agg(F.max("version").alias("last")), order).write.mode("append").parquet(f"{path}/changes")


def replay(changes: DataFrame) -> DataFrame:
    """(thread, at, message, role, text): the last put of each message, if nothing removed it later; ``at`` is kept apart."""
    last = changes.groupBy("thread", "at", "message").agg(F.max_by(F.struct("op", "role", "text"), "version").alias("last"))
    return last.where("last.op = 'put'").select("thread", "at", "message", "last.role", "last.text")


def state_at(changes: DataFrame, snapshots: DataFrame, marks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(thread, at, message, role, text) of each wanted (thread, at); later versions than there are give the last one."""
    wanted = wanted.select("thread", "at").distinct()
    before = wanted.join(marks.withColumnRenamed("version", "mark"), "thread", "left")
    base = before.groupBy("thread", "at").agg(F.coalesce(F.max(F.when(F.col("mark") <= F.col("at"), F.col("mark"))), F.lit(0)).alias("since"))
    kept = base.join(snapshots.withColumnRenamed("at", "since"), ["thread", "since"]).select("thread", "at", F.col("since").alias("version"), "message", F.lit("put").alias("op"), "role", "text")
    newer = base.join(changes, "thread").where("version > since AND version <= at").select("thread", "at", "version", "message", "op", "role", "text")
    return replay(kept.unionByName(newer))


def restore(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    return state_at(_table(spark, path, "changes", CHANGES), _table(spark, path, "snapshots", SNAPSHOTS), _table(spark, path, "marks", "thread long, version long"), wanted)


def write_snapshots(spark: SparkSession, path: str, every: int = EVERY) -> int:
    """Snapshots of the threads that have grown by ``every`` changes or more since their last; how many there are."""
    changes, marks = _table(spark, path, "changes", CHANGES), _table(spark, path, "marks", "thread long, version long")
    grown = changes.groupBy("thread").agg(F.max("version").alias("last")).join(marks.groupBy("thread").agg(F.max("version").alias("mark")), "thread", "left")
    due = grown.withColumn("at", F.col("last") - F.col("last") % every).where(F.col("at") > F.coalesce("mark", F.lit(0))).select("thread", "at")
    due.write.mode("overwrite").parquet(f"{path}/due")  # both tables take the same threads
    due = spark.read.schema("thread long, at long").parquet(f"{path}/due")
    restore(spark, path, due).write.mode("append").parquet(f"{path}/snapshots")
    due.select("thread", F.col("at").alias("version")).write.mode("append").parquet(f"{path}/marks")
    return due.count()
