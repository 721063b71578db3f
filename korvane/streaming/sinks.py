"""Sinks that write a batch once, whatever is repeated.

A batch is written into a folder of its own and counts once its number is recorded beside the data. A batch that comes
again after that writes nothing; one that died before is written anew. Readers see recorded batches only. Numbers belong
to a writer's name, since each query counts its own batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from korvane.functions.text import sse_encode
from korvane.operators.ingest import absent
from korvane.session import exists


def _data(path: str, writer: str, batch_id: int) -> str:
    return f"{path}/data/writer={writer}/batch={batch_id}"


def _record(path: str, writer: str, batch_id: int) -> str:
    return f"{path}/written/{writer}-{batch_id}"


def write_batch(rows: DataFrame, batch_id: int, path: str, writer: str = "main", make: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Write a batch unless it is recorded; whether it was written. ``make`` turns what is new of it into what is stored."""
    spark = rows.sparkSession
    if exists(spark, f"{_record(path, writer, batch_id)}/_SUCCESS"):
        return False
    (make(rows) if make else rows).write.mode("overwrite").parquet(_data(path, writer, batch_id))
    record = spark.createDataFrame([(writer, batch_id)], "writer string, batch long")
    record.coalesce(1).write.mode("overwrite").parquet(_record(path, writer, batch_id))
    return True


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of recorded batches, with writer and batch."""
    whole = f"{schema}, writer string, batch long"
    if not exists(spark, f"{path}/written"):
        return spark.createDataFrame([], whole)
    written = spark.read.schema("writer string, batch long").option("recursiveFileLookup", True).parquet(f"{path}/written")
    return spark.read.schema(whole).parquet(f"{path}/data").join(written, ["writer", "batch"], "left_semi")


def start_exactly_once(rows: DataFrame, path: str, checkpoint: str, writer: str = "main", available_now: bool = True) -> StreamingQuery:
    out = rows.writeStream.foreachBatch(lambda batch, i: write_batch(batch, i, path, writer)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def start_insert_if_absent(rows: DataFrame, path: str, checkpoint: str, key: str, order: Sequence[str], writer: str = "main") -> StreamingQuery:
    """Rows whose key no recorded batch has; the first of each key in ``order`` within a batch."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def new(batch: DataFrame) -> DataFrame:
        return absent(batch, read_batches(batch.sparkSession, path, schema), key, order)

    return rows.writeStream.foreachBatch(lambda batch, i: write_batch(batch, i, path, writer, new)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_server_events(events: DataFrame, path: str, checkpoint: str, columns: Sequence[str], writer: str = "main") -> StreamingQuery:
    """Server-sent events, a frame for each row, with those columns as JSON."""
    return start_exactly_once(events.select(sse_encode(F.struct(*columns)).alias("frame")), path, checkpoint, writer)
