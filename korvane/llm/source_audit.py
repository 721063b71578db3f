"""Divergence of sources within each language, by wide term vectors.

Every kept term of a language is one row with an array of its counts, a place for each source of the language. Higher-order
functions turn the counts into shares, and a row into the contributions of all pairs of its sources; sums of those combine
in each task before they are shuffled. No Python runs, and no row is larger than the number of a language's sources.

Definitions. A null text, language or source is the empty one. A row is a document, so rows that repeat count again. Terms
are runs of ASCII letters and of what isn't ASCII, with A to Z in lower case. A language keeps the terms of at least
``MIN_DOCS`` of its documents. A share is ``1 + floor(SCALE * (count + 2) / (N + 2 * V))`` and a divergence
``floor((p - q)^2 / (p + q))``, in integers; they are exact below 2.8e14 occurrences in a group. Equal values rank by item,
in the order of UTF-8. A language without kept terms has pairs of value 0 and no terms, one with a single source no pairs;
an empty table gives nothing. Other columns aren't read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

MIN_DOCS, TOP_TERMS = 10, 10
#: SCALE in two factors: a product of one of them and a count fits a long.
SCALE_A, SCALE_B = 32_000, 31_250
#: Parts that the terms of a language are dealt over where they meet its totals, which come in as many copies.
PARTS = 64
NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A to Z in lower case, nothing else; texts of ASCII alone take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def share(count: str, total: str, terms: str = "v") -> str:
    """The smoothed share of a count, in SQL."""
    a, d = f"(({count} + 2) * {SCALE_A})", f"({total} + 2 * {terms})"
    return f"(1 + {a} div {d} * {SCALE_B} + ({a} % {d} * {SCALE_B}) div {d})"


def divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): how often a term occurs in a group, and in how many of its documents."""
    terms = docs.select("lang", "source", F.split(lowered(F.col("text")), NOT_TERM).alias("w"))
    # once with all terms and once with the different ones, so that one pass counts both
    both = terms.select("lang", "source", F.posexplode(F.array("w", F.array_distinct("w"))).alias("once", "w"))
    each = both.select("lang", "source", "once", F.explode("w").alias("term")).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("once") == 0).alias("n"), F.count_if(F.col("once") == 1).alias("n_docs"))


def source_places(docs: DataFrame) -> DataFrame:
    """(lang, source, place, places): each source's place in the arrays of its language, and their length."""
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    of_lang = Window.partitionBy("lang")
    return groups.select("lang", "source", (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"), F.count("*").over(of_lang).cast("int").alias("places"))


def wide_terms(counts: DataFrame, places: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, counts): kept terms, each with its count in every source of the language."""
    placed = counts.join(places, ["lang", "source"])
    rows = placed.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.max("places").alias("places"), F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("n"))
    return rows.where(F.col("n_docs") >= min_docs).select("lang", "term", F.expr("transform(sequence(0, places - 1), i -> coalesce(n[i], 0L))").alias("counts"))


def with_shares(wide: DataFrame) -> DataFrame:
    """``wide`` with p, the share in each source, and q, that in the language."""
    cells = wide.select("lang", F.posexplode("counts").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    totals = cells.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("totals"), F.max("v").alias("v"), F.sum("n").alias("total"))
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    copies = totals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))  # a row has a number for each source
    joined = wide.withColumn("part", part).join(copies, ["lang", "part"])
    return joined.select(
        "lang", "term", "counts",
        F.expr(f"transform(counts, (n, i) -> {share('n', 'totals[i]')})").alias("p"),
        F.expr(share("aggregate(counts, 0L, (s, n) -> s + n)", "total")).alias("q"),
    )


def pair_sums(shares: DataFrame) -> DataFrame:
    """(lang, pair, value): summed divergences of sources i < j of a language, numbered (0, 1), (0, 2), ..., (1, 2), ..."""
    each = F.expr(f"flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> {divergence('x', 'y')})))")
    return shares.select("lang", F.posexplode(each).alias("pair", "f")).groupBy("lang", "pair").agg(F.sum("f").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others, and which terms set it apart."""
    column = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(column(lang_col).alias("lang"), column(source_col).alias("source"), column(text_col).alias("text"))
    places = materialise(source_places(rows), "places")
    wide = materialise(wide_terms(term_counts(rows), places, min_docs), "wide")
    shares = with_shares(wide)

    # every ordered pair of a language's sources is a row of the result
    low, high = F.least("place", "other"), F.greatest("place", "other")
    ordered = places.select("*", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("other")).where("place <> other")
    ordered = ordered.withColumn("pair", (low * F.col("places") - F.floor(low * (low + 1) / 2) + high - low - 1).cast("int"))
    names = places.select("lang", F.col("source").alias("item"), F.col("place").alias("other"))
    pairs = ordered.join(pair_sums(shares), ["lang", "pair"], "left").join(names, ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))

    cells = shares.select("lang", "term", "q", F.inline(F.expr("transform(p, (x, i) -> named_struct('place', i, 'p', x, 'n', counts[i]))"))).where("n > 0 AND p > q")
    terms = cells.select("lang", "place", F.col("term").alias("item"), F.expr(divergence("p", "q")).alias("value"))
    best = Window.partitionBy("lang", "place").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)  # also applied in each task before the shuffle
    terms = terms.join(places, ["lang", "place"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
