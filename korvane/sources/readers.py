"""Readers of chunk files, documents, captions and JSON lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.operators.transcript import cues

CHUNK_SCHEMA = (
    "chunk_id string, source_document string, chunk_text string, original_text string, contextual_prefix string, "
    "metadata struct<chapter_title:string,section_title:string,subsection_title:array<string>,summary:string>, token_count int, _corrupt_record string"
)
REQUIRED = ("chunk_id", "source_document", "token_count", "chunk_text")
MEDICATION_FIELDS = ("name", "class", "uses", "dosage", "side_effects", "warnings", "interactions")


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def parquet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return require(spark.read.parquet(path), columns)


def _file() -> Column:
    return F.col("_metadata.file_path")


def chunk_files(spark: SparkSession, path: str, pattern: str = "*_chunk*.json") -> tuple[DataFrame, DataFrame]:
    """One JSON file a chunk, in all folders below: (chunks with flat metadata and their file, files that lack a field)."""
    reader = spark.read.schema(CHUNK_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    raw = reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("source_file", _file())
    bad = F.col("_corrupt_record").isNotNull()
    for c in REQUIRED:
        bad = bad | F.col(c).isNull()
    text = lambda c: F.coalesce(F.col(f"metadata.{c}"), F.lit("")).alias(c)
    good = raw.where(~bad).select(
        *REQUIRED, "original_text", text("chapter_title"), text("section_title"), F.coalesce("metadata.subsection_title", F.array().cast("array<string>")).alias("subsection_title"),
        text("summary"), "source_file",
    )
    return good, raw.where(bad).select("source_file", "_corrupt_record")


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).json(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, content, sha256) of all text and Markdown files; the id is the file's name without its ending."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)
    return files.select(name.alias("document_id"), F.col("value").alias("content"), F.sha2("value", 256).alias("sha256")).where(F.btrim("content") != "")


def captions(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """The captions of the WebVTT files of a folder; only of the first so many, by their paths, if that is given.

    A folder without such files, an empty file and one that doesn't begin as WebVTT are errors.
    """
    files = spark.read.option("pathGlobFilter", "*.vtt").text(path, wholetext=True)
    files = files.select("value", _file().alias("file"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.vtt$", 1).alias("video_id"))
    if first is not None:
        files = files.join(F.broadcast(files.select("file").orderBy("file").limit(first)), "file", "left_semi")  # so many paths
    if files.select("file").isEmpty():
        raise ValueError(f"{path} has no WebVTT files")
    bad = F.raise_error(F.concat(F.lit("not WebVTT: "), "file")).cast("string")
    files = files.withColumn("value", F.when(F.col("value").rlike("^\ufeff?WEBVTT"), F.col("value")).otherwise(bad))
    return cues(files)


def json_documents(spark: SparkSession, path: str, fields: Sequence[str] = MEDICATION_FIELDS) -> DataFrame:
    """(id, content, metadata): items of a JSON list, their fields a line each, with the field's name before it.

    ``metadata`` is the whole item as JSON, with whatever fields it has.
    """
    lists = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<variant>").alias("items"))
    item = lists.select(F.explode("items").alias("item"))
    rows = item.select(F.to_json("item").alias("metadata"), *[F.try_variant_get("item", f"$.{f}", "string").alias(f) for f in ("id", *fields)])
    return rows.select("id", F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f"`{f}`"), F.lit(""))) for f in fields]).alias("content"), "metadata")
