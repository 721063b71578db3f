"""Which characters of a text its chunks cover: gaps, the map of segments, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvane.session import unused

SIGNIFICANT = 5


def gaps(intervals: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(key, start, end) of all maximal runs that no interval (key, start, end) covers; ``lengths`` has (key, length).

    A text without an interval is one gap; an empty text has none.
    """
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    so_far, last = unused(intervals, "_reach"), unused(lengths, "_last")
    known = intervals.withColumn(so_far, F.coalesce(reach, F.lit(0))).where(F.col("start") > F.col(so_far)).select(key, F.col(so_far).alias("start"), F.col("start").alias("end"))
    ends = intervals.groupBy(key).agg(F.max("end").alias(last))
    tails = lengths.join(ends, key, "left").select(key, F.coalesce(last, F.lit(0)).cast("long").alias("start"), F.col("length").cast("long").alias("end")).where("start < end")
    return known.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).unionByName(tails)


def coverage_map(intervals: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(key, start, end, type): a segment for each interval and each gap."""
    covered = intervals.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit("covered").alias("type"))
    return covered.unionByName(gaps(intervals, lengths, key).withColumn("type", F.lit("gap")))


def summary(intervals: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """For each text: characters, covered ones and their percentage (100 of an empty text), gaps and significant gaps."""
    size = F.col("end") - F.col("start")
    found = gaps(intervals, lengths, key).groupBy(key).agg(
        F.sum(size).alias("_open"), F.count("*").alias("n_gaps"), F.count_if(size > SIGNIFICANT).alias("n_significant")
    )
    covered = F.col("length") - F.coalesce("_open", F.lit(0))
    return lengths.join(found, key, "left").select(
        key, F.col("length").cast("long").alias("length"), covered.cast("long").alias("covered"), F.coalesce(F.round(F.try_divide(100.0 * covered, F.col("length")), 2), F.lit(100.0)).alias("percent"),
        F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), F.coalesce("n_significant", F.lit(0)).alias("n_significant"),
    )
