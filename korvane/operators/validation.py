"""Rules over chunk and section tables: one scan finds all violations of a row's own fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Summaries that stand for none; titles and summaries that do in metadata.
PLACEHOLDERS = ("todo", "n/a", "none", "tbd", "...", "summary")
METADATA_PLACEHOLDERS = (*PLACEHOLDERS, "tba")
CHUNK_ID = r"^.+_chunk_\d{3,}$"
TABLE_NAME = r"[A-Za-z_][A-Za-z0-9_]{0,62}"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Limits: characters of a section's summary and hints, of a chunk's summary and a message; a section's level; coverage.
SECTION_SUMMARY, HINT, SUMMARY, MESSAGE, LEVELS, COVERAGE = 3000, 1000, (10, 500), 5000, (1, 5), 0.99


def blank(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit(""))) == ""


def chunk_rules(max_tokens: int = 1000) -> list[tuple[str, str, Column]]:
    """(rule, severity, violated) for rows of chunks."""
    summary = F.coalesce(F.col("summary"), F.lit(""))
    return [
        ("chunk_id", "error", ~F.coalesce(F.col("chunk_id").rlike(CHUNK_ID), F.lit(False))),
        ("chunk_text", "error", blank(F.col("chunk_text"))),
        ("title", "error", blank(F.col("chapter_title"))),
        ("token_count", "error", F.coalesce(F.col("token_count"), F.lit(0)) < 1),
        ("too_long", "error", F.coalesce(F.col("token_count"), F.lit(0)) > max_tokens),
        ("summary_length", "warning", ~F.length(summary).between(*SUMMARY)),
        ("summary_placeholder", "warning", F.lower(F.btrim(summary)).isin(*PLACEHOLDERS)),
    ]


def metadata_rules() -> list[tuple[str, str, Column]]:
    """Titles and summaries that say nothing, and summaries too short."""
    stands_for_none = lambda c: F.coalesce(F.lower(F.btrim(F.col(c))), F.lit("")).isin(*METADATA_PLACEHOLDERS)
    named = [(f"{c}_placeholder", "error", stands_for_none(c)) for c in ("chapter_title", "section_title", "summary")]
    return [*named, ("summary_too_short", "error", F.length(F.btrim(F.coalesce(F.col("summary"), F.lit("")))) < SUMMARY[0])]


def document_rules(max_tokens: int = 1000) -> list[tuple[str, str, Column]]:
    """What the chunks of a finished document must have."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return [
        ("chapter_title", "error", missing("chapter_title")),
        ("section_title", "error", missing("section_title")),
        ("summary", "warning", missing("summary")),
        ("too_long", "error", F.coalesce(F.col("token_count"), F.lit(0)) > max_tokens),
    ]


def section_rules() -> list[tuple[str, str, Column]]:
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    return [
        ("title", "error", size("title") < 1),
        ("level", "error", ~F.coalesce(F.col("level").between(*LEVELS), F.lit(False))),
        ("summary_length", "error", ~size("summary").between(1, SECTION_SUMMARY)),
        ("summary_short", "warning", size("summary") < SUMMARY[0]),
        ("start_words", "error", size("start_words") > HINT),
        ("end_words", "error", size("end_words") > HINT),
    ]


def message_rules() -> list[tuple[str, str, Column]]:
    return [
        ("text", "error", ~F.length(F.coalesce(F.col("text"), F.lit(""))).between(1, MESSAGE)),
        ("session_id", "error", F.col("session_id").isNotNull() & ~F.lower("session_id").rlike(UUID)),
    ]


def coverage_violations(ratios: DataFrame, id_col: str, ratio_col: str = "ratio", least: float = COVERAGE) -> DataFrame:
    """(id, rule, severity): ratios that aren't from 0 to 1, and documents that are covered too little."""
    ratio = F.col(ratio_col)
    known = F.coalesce(ratio.between(0, 1), F.lit(False))
    return violations(ratios, [("ratio", "error", ~known), ("coverage", "error", known & (ratio < least))], id_col)


def count_mismatches(reports: DataFrame, rows: DataFrame, key: str, reported: str) -> DataFrame:
    """(key, reported, found): where a report's number of rows isn't that of the table; 0 where it has none."""
    found = rows.groupBy(key).agg(F.count("*").alias("found"))
    both = reports.select(key, F.col(reported).cast("long").alias("reported")).join(found, key, "left")
    return both.withColumn("found", F.coalesce("found", F.lit(0))).where(~F.col("reported").eqNullSafe(F.col("found")))


def outcome(found: DataFrame, strict: bool = False) -> DataFrame:
    """One row: errors, warnings, and whether all passed; if strict a warning fails too."""
    counts = found.agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    return counts.withColumn("passed", (F.col("n_errors") == 0) & ((F.col("n_warnings") == 0) | F.lit(not strict)))


def require_rows(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise ValueError("there are no rows")
    return rows


def accepted(rows: DataFrame, rules: list[tuple[str, str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule of severity error, and the others with ``reasons``, the rules in order."""
    broken = F.filter(F.array(*[F.when(v, F.lit(rule)) for rule, severity, v in rules if severity == "error"]), lambda x: x.isNotNull())
    judged = rows.withColumn("reasons", broken)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def violations(rows: DataFrame, rules: list[tuple[str, str, Column]], id_col: str = "chunk_id") -> DataFrame:
    """(id, rule, severity), a row for each rule that a row breaks."""
    broken = F.array(*[F.when(v, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, severity, v in rules])
    return rows.select(F.col(id_col).alias("id"), F.inline(F.filter(broken, lambda x: x.isNotNull())))


def missing_parents(sections: DataFrame) -> DataFrame:
    """Sections whose parent is no title of their document; null is the root."""
    titles = sections.select("document_id", F.col("title").alias("parent_section")).distinct()
    return sections.where(F.col("parent_section").isNotNull()).join(titles, ["document_id", "parent_section"], "left_anti")


def schema_difference(rows: DataFrame, expected: dict[str, str]) -> tuple[set[str], set[str], set[str]]:
    """Columns that are missing, that are too many, and that have another type."""
    found = dict(rows.dtypes)
    return set(expected) - set(found), set(found) - set(expected), {c for c in set(expected) & set(found) if expected[c] != found[c]}


def table_name(name: str) -> str:
    """``name`` in backticks, if it is a plain one."""
    if not re.fullmatch(TABLE_NAME, name):
        raise ValueError(f"not a table's name: {name}")
    return f"`{name}`"
