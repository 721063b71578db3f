"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, the source's target over its size. Whole copies are
taken; the fractional one is a probability that rounding turns into 0 or 1. Rounding works on mass, the probability times
the words: a document is paired with the pool of the smaller ones of its group, whose members share one probability, and
mass moves at random to one or the other until one of both is integral. Expectations and the words of a group stay as they
are, and one document of it at most remains fractional, mostly a small one. Those residuals meet in groups of 64, again
and again, until one of each source is left, which is drawn. So a source misses its target by the words of one document at
most.

Groups are parts of a source by a hash of doc_id, as many as its documents need, so a hot source is many tasks; a task
streams through its groups. Draws are hashes of the documents paired: reruns agree, however the table is partitioned.

Definitions. A null text has no words. Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating. Rows
that repeat are documents of their own. Documents without words, and all of a source without words, are taken 0 times. An
empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
#: Documents of a group, about; residuals that meet; the share of all rows from which a source is broadcast, which bounds their number.
GROUP_DOCS, FAN_BITS, HOT = 4096, 6, 1000
FIELDS = "doc_id long, size long, source_key string, source_size long, target double, copies long, chance double, bits int, part long, h long, open boolean"


def word_count(text: Column) -> Column:
    """How many runs of other than white space (U+0020, U+0009 to U+000D) there are."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.element_at(parts, -1) == "") & (F.size(parts) > 1), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def scale_of(sources: DataFrame, budget: Fraction, most: int = MOST) -> Fraction:
    """The factor of weights that shares ``budget`` where no source of (weight, source_size) takes more than ``most`` times its size.

    A source that is full stays full as the factor grows, so a few rounds of one aggregate each settle it.
    """
    factor, full = Fraction(0), -1
    while True:
        capped = F.col("weight") * F.lit(float(factor)) >= most * F.col("source_size")
        row = sources.agg(F.count_if(capped).alias("full"), F.sum(F.when(capped, most * F.col("source_size"))).alias("words"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        if row["full"] == full or not row["weight"]:
            return factor
        full, factor = row["full"], Fraction(budget - (row["words"] or 0)) / row["weight"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """(source_key, n, source_size, target): the words to be taken of each source."""
    sources = sizes.groupBy("source_key").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranked = _numbered(materialise(sources, "sources"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("weight", weight), "weighted")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    factor = scale_of(ranked, share * total, most)
    target = F.least(F.lit(float(factor)) * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return ranked.select("source_key", "n", "source_size", target.alias("target"))


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with their rank from 0: ranks within ranges of names, after those before each range."""
    ranged = materialise(sources.orderBy("source_key").withColumn("range", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("range").agg(F.count("*").alias("n_range"))
    before = before.select("range", (F.sum("n_range").over(Window.orderBy("range")) - F.col("n_range")).alias("before"))  # a row for each task
    return ranged.join(before, "range").select("source_key", "n", "source_size", (F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("source_key")) - 1).alias("rank"))


def _draw(a: int, b: int) -> float:
    """A number from 0 to 1 of two hashes."""
    x = (a * 0x9E3779B97F4A7C15 ^ (b + 0x632BE59BD9B4E019)) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 31) >> 11) / 2**53


def fight(a: float, most_a: float, b: float, most_b: float, draw: float) -> tuple[float, float]:
    """Mass moves between a and b until one of them is 0 or full; on average neither changes."""
    to_a, to_b = min(most_a - a, b), min(a, most_b - b)
    if draw * (to_a + to_b) < to_b:
        return (most_a, b - to_a) if to_a == most_a - a else (a + b, 0.0)
    return (0.0, b + a) if to_b == a else (a - to_b, most_b)


def round_groups(rows: DataFrame, pooled: bool) -> DataFrame:
    """``rows`` (FIELDS), sorted by group and from the largest size, with chances of 0 and 1 but for one of each group, which is open.

    Pooled groups begin with equal chances; ``pool`` then has the words of the whole group.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    schema = pa.schema([pa.field(n, {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}.get(f.split()[1], pa.int64())) for n, f in zip(names, FIELDS.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, pool, chance = None, None, 0, 0.0  # held: the fractional row; pool: words and chance of what follows in the group
        for batch in batches:
            out = []
            columns = batch.to_pydict()
            pools = columns.pop("pool")
            for row, words in zip(zip(*columns.values(), strict=True), pools, strict=True):
                row = dict(zip(names, row, strict=True))
                if (key := (row["source_key"], row["part"])) != group:
                    if held:
                        out.append(held)
                    group, held, pool, chance = key, None, words, row["chance"]
                size = row["size"]
                if pooled:
                    pool -= size
                    row["chance"] = chance
                if not 0 < row["chance"] < 1 or not size:
                    out.append(row | {"chance": float(row["chance"] >= 1 and size > 0), "open": False})
                    continue
                mass = row["chance"] * size
                if pooled and not pool:  # the last one
                    if held is None:
                        held = row | {"open": True}
                    else:
                        out.append(row)  # can't be: whatever holds has emptied or filled its pool
                    continue
                if pooled:
                    mass, rest = fight(mass, float(size), chance * pool, float(pool), _draw(row["h"], pool))
                    chance = 0.0 if rest <= 0 else 1.0 if rest >= pool else rest / pool
                    if 0 < mass < size:
                        held = row | {"chance": mass / size, "open": True}
                    else:
                        out.append(row | {"chance": float(mass > 0), "open": False})
                    continue
                if held is None:
                    held = row | {"open": True}
                    continue
                a, most = held["chance"] * held["size"], float(held["size"])
                a, b = fight(a, most, mass, float(size), _draw(held["h"], row["h"]))
                still = None
                for x, y, top in ((held, a, most), (row, b, float(size))):
                    if 0 < y < top:
                        still = x | {"chance": y / top, "open": True}
                    else:
                        out.append(x | {"chance": float(y > 0), "open": False})
                held = still
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    return rows.mapInArrow(run, FIELDS)


def _sorted(rows: DataFrame) -> DataFrame:
    """Groups side by side, each from the largest document, with the words of the whole group."""
    words = F.sum("size").over(Window.partitionBy("source_key", "part"))
    placed = rows.withColumn("pool", words)  # its shuffle is the only one
    return placed.sortWithinPartitions("source_key", "part", F.desc("size"), "h", "doc_id")


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every document: how many words of it the mix takes."""
    source = F.col(f"`{source_col}`").cast("string")
    key = F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))  # null last
    sizes = materialise(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), word_count(F.col(f"`{text_col}`")).alias("size"), key.alias("source_key")), "sizes")
    targets = materialise(source_targets(sizes, weights, share, most), "targets")
    rows = sizes.count()  # from the files' footers
    hot = F.col("n") * HOT >= rows
    often = F.broadcast(targets.where(hot))  # at most HOT sources
    known = sizes.join(often, "source_key").unionByName(sizes.join(often.select("source_key"), "source_key", "left_anti").join(targets.where(~hot), "source_key"))

    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    copies = F.floor(ratio)
    known = known.withColumn("copies", copies).withColumn("chance", ratio - copies)
    known = known.withColumn("bits", F.ceil(F.log2(F.greatest(F.ceil(F.col("n") / GROUP_DOCS), F.lit(1)))).cast("int"))
    known = known.withColumn("h", F.xxhash64("doc_id", "size")).withColumn("part", F.expr("h & (shiftleft(1L, bits) - 1)")).withColumn("open", F.lit(True))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    done, bits = [], max(0, -(-(targets.agg(F.max("n")).first()[0] or 0) // GROUP_DOCS) - 1).bit_length()
    level = materialise(round_groups(_sorted(known.select(*names)), True), "rounded")
    done.append(level.where("NOT open"))
    while bits > 0:  # residuals of 64 groups meet
        met = level.where("open").withColumn("part", F.expr(f"shiftright(part, {FAN_BITS})"))
        level = materialise(round_groups(_sorted(met.select(*names)), False), "rounded")
        done.append(level.where("NOT open"))
        bits -= FAN_BITS
    # the last of each source is drawn alone
    last = level.where("open").withColumn("chance", F.when(F.pmod(F.xxhash64("h", "source_key"), F.lit(1 << 40)) / (1 << 40) < F.col("chance"), 1.0).otherwise(0.0))
    all_rows = last
    for part in done:
        all_rows = all_rows.unionByName(part)
    whole = (F.col("copies") + F.col("chance").cast("long")).alias("copies")
    return all_rows.select("doc_id", "size", "source_size", "target", (whole * F.col("size")).alias("taken"), whole)
