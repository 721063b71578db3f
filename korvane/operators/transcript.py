"""Captions: speakers, clean texts, merged turns, offsets in the joined text, and what a range of it overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.session import fixed, unused

CUE = r"(?m)^([0-9:.]+)\s+-->\s+([0-9:.]+)"


def cues(files: DataFrame, key: str = "video_id", text_col: str = "value") -> DataFrame:
    """(key, idx, start, end, speaker, text) of whole WebVTT files; empty captions are left out. Cue names aren't text."""
    blocks = files.select(key, F.posexplode(F.split(F.regexp_replace(text_col, "\r", ""), "\n\n+")).alias("idx", "block"))
    timed = blocks.where(F.col("block").rlike(CUE))
    body = F.array_join(F.split(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", ""), "\n"), " ")
    rows = timed.select(key, "idx", F.regexp_extract("block", CUE, 1).alias("start"), F.regexp_extract("block", CUE, 2).alias("end"), speaker_of(body).alias("speaker"), clean_caption(body).alias("text"))
    return rows.where("text <> ''")


def speaker_of(text: Column) -> Column:
    """``Name: ...`` or ``<v Name>``; null without one."""
    by = lambda p: F.nullif(F.btrim(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.coalesce(by(r"^([A-Za-z\s]+):\s*"), by(r"^<v\s+([^>]+)>"))


def clean_caption(text: Column) -> Column:
    """Without voice tags, the speaker, and any other tag; white space becomes one space."""
    for pattern in (r"<v\s+[^>]+>", r"^[A-Za-z\s]+:\s*", r"<[^>]+>"):
        text = F.regexp_replace(text, pattern, "")
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def plain_text(vtt: Column) -> Column:
    """A whole WebVTT file as one line: without blank lines, its head and times; cue names stay."""
    lines = F.filter(F.transform(F.split(vtt, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~x.startswith("WEBVTT") & ~x.contains("-->"))
    return F.regexp_replace(F.array_join(lines, " "), " {2,}", " ")


def video_title(name: Column) -> Column:
    """The title in ``video_<number>_<title>``: underscores are spaces, dates of 7 or 8 digits go; else the name itself."""
    title = F.regexp_replace(F.regexp_extract(name, r"video_(\d+)_(.+)", 2), "_", " ")
    title = F.regexp_replace(F.btrim(F.regexp_replace(title, r"\d{7,8}", "")), "[：.]+$", "")
    return F.coalesce(F.nullif(F.btrim(title), F.lit("")), name)


def video_number(name: Column) -> Column:
    """The number in ``video_<number>_<title>``, null without one."""
    return F.nullif(F.regexp_extract(name, r"video_(\d+)_(.+)", 1), F.lit("")).cast("long")


def merge_speakers(captions: DataFrame, key: str, order: str) -> DataFrame:
    """Neighbours of one speaker become one turn: (key, turn, first, last, speaker, text).

    An unknown speaker goes on with the turn before; if the first one is unknown, all is one turn.
    """
    window = Window.partitionBy(key).orderBy(order)
    first, filled, turn = unused(captions, "_first"), unused(captions, "_filled"), unused(captions, "_turn")
    rows = captions.withColumn(first, F.first("speaker").over(window)).withColumn(filled, F.last("speaker", ignorenulls=True).over(window))
    change = F.col(first).isNotNull() & (F.col(filled) != F.lag(filled).over(window))
    rows = rows.withColumn(turn, F.sum(F.when(change, 1).otherwise(0)).over(window))
    texts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t"))))
    return rows.groupBy(key, F.col(turn).alias("turn")).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.min_by("speaker", order).alias("speaker"), F.array_join(F.transform(texts, lambda x: x["t"]), " ").alias("text")
    )


def with_offsets(captions: DataFrame, key: str, order: str) -> DataFrame:
    """Captions with char_start and char_end in the texts joined by single spaces."""
    size = F.length(F.coalesce("text", F.lit("")))
    before = F.sum(size + 1).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return captions.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + size)


def overlapping(ranges: DataFrame, captions: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """Each range (key, start, end, ...) with each caption (key, char_start, char_end, ...) that it shares a character with.

    Both are dealt into bins of ``width`` characters and joined by bin, so a long transcript isn't one key; a pair
    counts in the first bin that it shares.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / width)))
    left = ranges.withColumn("_bin", bins("start", "end"))
    right = captions.withColumn("_bin", bins("char_start", "char_end"))
    shared = F.col("_bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("char_start") / width))
    return left.join(right, [key, "_bin"]).where((F.col("char_end") > F.col("start")) & (F.col("char_start") < F.col("end")) & shared).drop("_bin")


def times_and_speakers(ranges: DataFrame, captions: DataFrame, key: str, order: str) -> DataFrame:
    """(key, start, end) of each range with its first and last caption and the speakers in order of name.

    A range that no caption overlaps has the first and last of all captions and no speaker; without captions, nulls.
    """
    found = overlapping(ranges, captions, key).groupBy(key, "start", "end").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers")
    )
    ends = captions.groupBy(key).agg(F.min(order).alias("all_first"), F.max(order).alias("all_last"))
    every = ranges.select(key, "start", "end").distinct().join(found, [key, "start", "end"], "left").join(ends, key, "left")
    return every.select(key, "start", "end", F.coalesce("first", "all_first").alias("first"), F.coalesce("last", "all_last").alias("last"), F.coalesce("speakers", F.lit("")).alias("speakers"))


def time_strings(found: DataFrame, captions: DataFrame, key: str, order: str, start: str = "time_start", end: str = "time_end") -> DataFrame:
    """The result of ``times_and_speakers`` with the times of its first and last caption; 00:00:00.000 without captions."""
    times = captions.select(key, F.col(order).alias("at"), F.col(start).alias("begins"), F.col(end).alias("stops"))
    firsts, lasts = times.select(key, F.col("at").alias("first"), "begins"), times.select(key, F.col("at").alias("last"), "stops")
    none = F.lit("00:00:00.000")
    timed = found.join(firsts, [key, "first"], "left").join(lasts, [key, "last"], "left")
    return timed.select(*found.columns, F.coalesce("begins", none).alias("time_start"), F.coalesce("stops", none).alias("time_end"))


def renumber(rows: DataFrame, order: list[str], parts: int = 256) -> DataFrame:
    """``global_id`` from 0 in the order of all rows, without one task for all: ranges are counted, then numbered apart."""
    part, i, n, sum_before = (unused(rows, c) for c in ("_part", "_i", "_n", "_before"))
    ranged = rows.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id())
    ranged = fixed(ranged.sortWithinPartitions(*order).withColumn(i, F.monotonically_increasing_id() - F.col(part).cast("long") * (1 << 33)))
    sizes = ranged.groupBy(part).agg(F.count("*").alias(n))  # at most ``parts`` rows
    before = sizes.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(sum_before))
    return ranged.join(F.broadcast(before), part).withColumn("global_id", F.col(sum_before) + F.col(i)).drop(part, i, sum_before)
