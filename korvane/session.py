"""SparkSession factory used by tests, the bench and local runs."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "korvane", **conf: str) -> SparkSession:
    """A local session with UTC, ANSI and AQE; on a cluster the caller brings its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Python workers find this package where the driver did, if its folder isn't on their path anyway."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of this machine for a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="korvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """``df`` through a reliable checkpoint, so that what depends on its partitions is the same wherever it is read."""
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """``df``, after its session is told to hand Python this many rows at a time at most: texts may be long.

    Spark itself ends a batch at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch), however few rows that is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
