"""What several training-data operators share: where tables are cut, and how texts reach Python."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.session import small_batches  # noqa: F401  (operators take it from here)

#: White space of the contracts: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, as in local tests, a folder of this machine is set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="korvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage, fixes whatever depends on row order, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/korvane/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def materialise_alone(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """``materialise`` what ``make`` gives, and delete the tables that were written on the way: nothing reads them any more."""
    before = len(_written)
    out = materialise(make(), tag)
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written[before:-1]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(settings).delete(folder, True)
    del _written[before:-1]
    return out


_held: dict = {}


def held(key: tuple, make: Callable):
    """The one large object that a Python worker keeps between tasks; it goes when another one is asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Tasks that need no such object call this first: workers outlive the operator that they served before."""
    _held.clear()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A key that has more than one in HOT_SHARE of all rows (and more than some number) is dealt over several tasks.
HOT_SHARE, HOT_ROWS = 100_000, 50_000


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], count: str, apart: list[str], hot_rows: int | None = None) -> DataFrame:
    """``many`` with the columns of the one row of ``few`` that has its ``keys``; ``count`` there is how many rows of ``many`` do.

    Rows of a hot key are dealt by a hash of the columns ``apart``, and its row of ``few`` comes in as many copies. There are
    fewer than HOT_SHARE hot keys at any size, so these, and nothing else, are broadcast. Rows without a partner, or with a
    null key, go; a count that is too low costs time only.
    """
    both = many.join(few, keys)
    part, parts = fresh(both, "part"), fresh(both, "parts")
    total = few.agg(F.sum(count)).first()[0] or 0  # one number
    share = max(total // HOT_SHARE, hot_rows or HOT_ROWS)
    needed = F.greatest(F.ceil(F.col(count) / share), F.lit(1)).cast("int")
    hot = few.where(F.col(count) > share).select(*keys, needed.alias(parts))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn(part, F.pmod(F.xxhash64(*apart), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    copies = few.withColumn(part, F.explode(F.sequence(F.lit(0), needed - 1)))
    return dealt.join(copies, [*keys, part]).drop(part)
