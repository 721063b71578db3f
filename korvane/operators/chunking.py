"""Documents to sections and chunks: structure tables, tags, numbered chunks, recursive splits, coverage of texts."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.session import small_batches, unused

EMPTY, ROOT = "[EMPTY]", "ROOT"
FIELDS = ("title", "level", "parent_section", "summary", "start_words", "end_words", "is_table")
FIELDS_V1 = FIELDS[:4]
FENCE = "```"


def parse_structure(responses: DataFrame, text_col: str = "text", id_col: str = "document_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """A row for each section line of a tab-separated response, numbered from 0.

    Blank lines, fences and a header are left out. A line with another number of fields is an error.
    """
    line = F.col("line")
    low = F.lower(line)
    header = low.contains("title") & low.contains("level") & low.contains("parent") & low.contains("summary")
    lines = responses.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", "\r$", "")).where((F.btrim(line) != "") & ~F.btrim(line).startswith(FENCE) & ~header)
    parts = F.split(line, "\t")
    checked = F.when(F.size(parts) == len(fields), parts).otherwise(F.raise_error(F.concat(F.lit(f"not {len(fields)} fields: "), line)).cast("array<string>"))
    rows = lines.withColumn("p", F.transform(checked, lambda x: F.btrim(x)))
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("document_id").orderBy("at")) - 1)
    cell = {name: F.get("p", F.lit(i)) for i, name in enumerate(fields)}
    shaped = {
        "level": lambda c: c.cast("int"),
        "parent_section": lambda c: F.nullif(c, F.lit(ROOT)),
        "start_words": lambda c: F.when(c == EMPTY, "").otherwise(c),
        "end_words": lambda c: F.when(c == EMPTY, "").otherwise(c),
        "is_table": lambda c: F.lower(c) == "true",
    }
    return rows.select("document_id", "idx", *[shaped.get(n, lambda c: c)(c).alias(n) for n, c in cell.items()])


def response_problem(text: Column) -> Column:
    """Why a response can't be a table: ``empty``, ``fenced``, ``chatty``; null if it may be one."""
    clean = F.btrim(F.coalesce(text, F.lit("")))
    return F.when(clean == "", "empty").when(clean.startswith(FENCE), "fenced").when(F.lower(clean).rlike("^here (is|are)"), "chatty")


def chapter_titles(sections: DataFrame) -> DataFrame:
    """(document_id, chapter_title): the first title of level 1, else the first at all."""
    first = F.min_by("title", F.when(F.col("level") == 1, F.col("idx")))
    return sections.groupBy("document_id").agg(F.coalesce(first, F.min_by("title", "idx"), F.lit("Unknown Chapter")).alias("chapter_title"))


def derive_metadata(sections: DataFrame) -> DataFrame:
    """Sections with their chapter and the titles of their children, one level below, in order."""
    children = (
        sections.where(F.col("parent_section").isNotNull())
        .groupBy("document_id", F.col("parent_section").alias("title"), (F.col("level") - 1).alias("level"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("title").alias("t")))), lambda x: x["t"]).alias("subsection_title"))
    )
    none = F.array().cast("array<string>")
    return (
        sections.join(children, ["document_id", "title", "level"], "left")
        .join(chapter_titles(sections), "document_id")
        .withColumn("subsection_title", F.coalesce("subsection_title", none))
    )


def chunk_ids(sections: DataFrame) -> DataFrame:
    """Sections that have words, with ``{document}_chunk_{number}``; numbers of three digits or more, from 1."""
    kept = sections.where((F.col("start_words") != "") | (F.col("end_words") != ""))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("idx"))
    return kept.withColumn("chunk_id", F.format_string("%s_chunk_%03d", F.col("document_id").cast("string"), number))


def chunk_text(prefix: Column, text: Column) -> Column:
    return F.concat(prefix, F.lit("\n\n"), text)


def tag(text: Column, name: str) -> Column:
    """What stands between ``[NAME]`` and the nearest ``[/NAME]``, of the last such pair; null without one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)\[{name}\](.*?)\[/{name}\]"), F.lit(1))
    return F.btrim(F.try_element_at(found, F.lit(-1)), F.lit(" \t\r\n"))


def parse_tags(rows: DataFrame, names: Sequence[str], text_col: str = "text") -> DataFrame:
    """A column for each tag, in order, and the names of those that lack."""
    tags = {n: tag(F.col(text_col), n) for n in names}
    lacking = F.filter(F.array(*[F.when(c.isNull(), n) for n, c in tags.items()]), lambda x: x.isNotNull())
    return rows.select("*", *[c.alias(n.lower()) for n, c in tags.items()], lacking.alias("missing_tags"))


def tag_problems(text: Column, names: Sequence[str], strict: bool = True) -> Column:
    """What is wrong with a text's tags, in order: ``missing``, ``uneven`` (opened and closed a different number of times),
    ``unordered`` (the n-th one closes before it opens), and if strict ``unexpected``; each followed by the tag's name."""
    text = F.coalesce(text, F.lit(""))
    problems = []
    for n in names:
        marks = F.regexp_extract_all(text, F.lit(rf"\[/?{n}\]"), F.lit(0))
        opens, closes = F.size(F.filter(marks, lambda m: ~m.startswith("[/"))), F.size(F.filter(marks, lambda m: m.startswith("[/")))
        depths = F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(False).alias("bad")), lambda s, m: F.struct((s["d"] + F.when(m.startswith("[/"), -1).otherwise(1)).alias("d"), (s["bad"] | (m.startswith("[/") & (s["d"] < 1))).alias("bad")))
        problems.append(F.when(opens + closes == 0, f"missing {n}").when(opens != closes, f"uneven {n}").when(depths["bad"], f"unordered {n}"))
    found = F.filter(F.array(*problems), lambda x: x.isNotNull())
    extra = F.array_except(F.regexp_extract_all(text, F.lit(r"\[(\w+)\]"), F.lit(1)), F.array(*map(F.lit, names)))
    return F.array_sort(F.concat(found, F.transform(extra, lambda n: F.concat(F.lit("unexpected "), n))) if strict else found)


def has_tag(text: Column, name: str) -> Column:
    return F.coalesce(tag(text, name).isNotNull(), F.lit(False))


METADATA = ("chapter_title", "section_title", "subsection_title", "summary")
PREFIX = "This chunk is from"


def chunk_metadata(text: Column) -> Column:
    """Four tab-separated fields of a response as a struct; ``NONE`` is no subsection. Another number is an error."""
    parts = F.split(F.btrim(text, F.lit(" \t\r\n")), "\t")
    checked = F.when(F.size(parts) == len(METADATA), parts).otherwise(F.raise_error(F.concat(F.lit("not 4 fields: "), text)).cast("array<string>"))
    cells = [F.btrim(F.get(checked, F.lit(i))) for i in range(len(METADATA))]
    cells[2] = F.when(F.upper(cells[2]) != "NONE", cells[2])
    return F.when(text.isNotNull(), F.struct(*[c.alias(n) for c, n in zip(cells, METADATA, strict=True)]))


def prefix_problem(text: Column) -> Column:
    """Why a contextual prefix can't be one: ``length`` (20 to 300 characters) or ``start``; null if it may be one."""
    clean = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    return F.when(~F.length(clean).between(20, 300), "length").when(~clean.startswith(PREFIX), "start")


def cache_key(operation: str, content: Column, model: str = "") -> Column:
    """``{operation}_{sha256}``, and the first eight digits of the model's hash if there is one."""
    key = F.concat(F.lit(f"{operation}_"), F.sha2(content, 256))
    return F.concat(key, F.lit("_"), F.substring(F.sha2(F.lit(model), 256), 1, 8)) if model else key


# --- texts ------------------------------------------------------------------------------------------------------------

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def pieces(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Runs of at most ``size`` characters without white space at their ends, cut at the first separator that the text has.

    A separator stays at the start of what follows it. Parts of ``size`` or more are cut at the separators after it;
    neighbours share up to ``overlap`` characters of whole parts. Only a part that no separator cuts is longer.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    cut = text.split(sep) if sep else []
    parts = [p for p in [*cut[:1], *(sep + p for p in cut[1:])] if p] if sep else list(text)
    out: list[str] = []
    held: deque[str] = deque()
    length = 0

    def close() -> None:
        whole = "".join(held).strip()
        if whole:
            out.append(whole)

    for part in parts:
        if len(part) >= size:
            close()
            held.clear()
            length = 0
            out += pieces(part, size, overlap, finer) if finer else [part]
            continue
        if length + len(part) > size:
            close()
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.popleft())
        held.append(part)
        length += len(part)
    close()
    return out


def split_recursive(text: Column, size: int, overlap: int = 0) -> Column:
    """The pieces of each text; ``small_batches`` of the rows bounds what a worker holds."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is needed")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces(t or "", size, overlap) for t in texts], dtype=object)

    return cut(text)


def parent_child_chunks(rows: DataFrame, key: str, text_col: str, parent_size: int = 3000, child_size: int = 600, overlap: int = 120) -> DataFrame:
    """Children with their parent: (key, parent_no, parent_start, parent_end, child_no, start, end, text).

    Parents share an overlap as children do. Places are of a text's first occurrence, ends excluded; children are numbered
    through their document. A null text has none.
    """
    if parent_size < child_size:
        raise ValueError("a parent is at least as large as a child")
    whole, parent, at, inside = (unused(rows, c) for c in ("_whole", "_parent", "_at", "_in"))
    parents = small_batches(rows).select(key, F.col(text_col).alias(whole), F.posexplode(split_recursive(F.col(text_col), parent_size, overlap)).alias("parent_no", parent))
    parents = parents.withColumn(at, F.expr(f"instr({whole}, {parent})") - 1).drop(whole)
    children = parents.select("*", F.posexplode(split_recursive(F.col(parent), child_size, overlap)).alias("child_no", "text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("parent_no", "child_no")) - 1
    children = children.withColumn("child_no", number).withColumn(inside, F.expr(f"instr({parent}, text)") - 1).where((F.col(at) >= 0) & (F.col(inside) >= 0))
    start = (F.col(at) + F.col(inside)).cast("long")
    return children.select(
        key, "parent_no", F.col(at).cast("long").alias("parent_start"), (F.col(at) + F.length(parent)).cast("long").alias("parent_end"),
        "child_no", start.alias("start"), (start + F.length("text")).alias("end"), "text",
    )
