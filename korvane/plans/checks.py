"""Scalar functions of texts and vectors, rules of whole tables, and an index that changes, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions import models
from korvane.functions import text as texts
from korvane.operators import alignment, history, lexical, stats, validation
from korvane.plans.base import CHUNKS, query, stored, table
from korvane.plans.corpus import middle_runs
from korvane.plans.retrieval import BM25, TEXT


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("""WITH l AS (SELECT doc_id, coalesce(source, '') AS source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, CAST(len(lines[:3]) + 1 AS BIGINT) AS n, sha256(list_aggregate(list_concat([source], lines[:3]), 'string_agg', chr(10))) AS queries_sha256 FROM l""")
def multi_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a response whose first lines are queries, beside the original one."""
    found = texts.multi_queries(F.col("text"), F.coalesce("source", F.lit("")))
    rows = _documents(spark, sf_dir).select("doc_id", found.alias("q"))
    return rows.select("doc_id", F.size("q").cast("long").alias("n"), F.sha2(F.array_join("q", "\n"), 256).alias("queries_sha256"))


@query("""WITH l AS (SELECT doc_id, coalesce(source, '') AS source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN i % 3 = 1 THEN trim(trim(x, ' '), ' ') ELSE '' END), lambda x: x <> '') AS q FROM documents)
SELECT doc_id, CAST(greatest(len(q), 4) AS BIGINT) AS n, sha256(list_aggregate(list_concat(q, list_resize([]::VARCHAR[], greatest(4 - len(q), 0), source)), 'string_agg', chr(10))) AS queries_sha256 FROM l""")
def expansion_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line of a text has a label; the source fills up to four queries."""
    labelled = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, " KEYWORDS: ").otherwise("OTHER: "), x))
    found = texts.expansion_queries(F.array_join(labelled, "\n"), F.coalesce("source", F.lit("")))
    rows = _documents(spark, sf_dir).select("doc_id", found.alias("q"))
    return rows.select("doc_id", F.size("q").cast("long").alias("n"), F.sha2(F.array_join("q", "\n"), 256).alias("queries_sha256"))


@query(f"""SELECT doc_id, sha256('<Instruct>: {models.INSTRUCTION}' || chr(10) || '<Query>: {TEXT}' || chr(10) || '<Document>: ' || coalesce(text, '')) AS prompt_sha256 FROM documents""")
def rerank_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(models.rerank_prompt(TEXT, F.coalesce("text", F.lit(""))), 256).alias("prompt_sha256"))


@query("SELECT vec_id, round(1 / (1 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)), 6) AS yes FROM embeddings")
def yes_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components as the logits of no and yes."""
    logit = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(models.yes_probability(logit(0), logit(1)), 6).alias("yes"))


@query("""WITH m AS (SELECT vec_id, list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda p: (p[1] + p[2]) / 2) AS m FROM embeddings),
n AS (SELECT vec_id, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS norm FROM m)
SELECT vec_id, round(CASE WHEN norm = 0 THEN 0 ELSE m[1] / norm END, 6) AS first, round(norm / nullif(norm, 0), 6) AS length FROM n""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each vector and itself read backwards."""
    pooled = models.mean_pooled(F.array("embedding", F.reverse("embedding")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", pooled.alias("m"))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("vec_id", F.round(F.get("m", F.lit(0)), 6).alias("first"), F.round(F.nullif(length, F.lit(0.0)), 6).alias("length"))


@query("SELECT event_id, round(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + (microsecond(ts) % 1000000) // 1000 / 1000.0::DOUBLE, 3) AS seconds FROM events")
def time_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events written as captions write them, and read again."""
    stamp = F.date_format("ts", "HH:mm:ss.SSS")
    return table(spark, sf_dir, "events").select("event_id", F.round(texts.seconds_of(stamp, strict=True), 3).alias("seconds"))


@query("SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '_start' ELSE '_complete' END AS type FROM events")
def stage_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 2 == 0, "started").otherwise("finished")
    return table(spark, sf_dir, "events").select("event_id", texts.event_type(F.col("event_type"), status).alias("type"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'rag_agent' ELSE 'emotional_support' END AS agent FROM conversations")
def agent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("role") == "user", " 'RAG_agent'\n").otherwise('"Emotional_Support" ')
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.agent_or_error(said).alias("agent"))


@query("SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(max(len(embedding)) AS BIGINT) AS dimension, max(len(embedding)) * 2 / 1024.0::DOUBLE AS half_kb, max(len(embedding)) * 4 / 1024.0::DOUBLE AS whole_kb FROM embeddings GROUP BY label")
def vector_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dimension"))
    return sizes.select("*", texts.storage_kb(F.col("dimension"), 2).alias("half_kb"), texts.storage_kb(F.col("dimension"), 4).alias("whole_kb"))


@query("""WITH m AS (SELECT conv_id || '/' || turn AS id, coalesce(text, '') AS text, turn FROM conversations)
SELECT id, 'text' AS rule, 'error' AS severity FROM m WHERE NOT length(text) BETWEEN 1 AND 5000 UNION ALL SELECT id, 'session_id', 'error' FROM m WHERE turn % 3 = 1""")
def message_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three turns one has no session, one a wrong and one a right id of its session."""
    uuid = F.regexp_replace(F.md5(F.col("conv_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    session = F.when(F.col("turn") % 3 == 1, "s1").when(F.col("turn") % 3 == 2, F.upper(uuid))
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text", session.alias("session_id"))
    return validation.violations(rows, validation.message_rules(), "id")


@query("""WITH s AS (SELECT doc_id AS document_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' '))) AS title, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS idx FROM documents),
p AS (SELECT *, CASE WHEN idx > 0 THEN lag(title) OVER (PARTITION BY document_id ORDER BY idx) || CASE WHEN idx % 4 = 3 THEN '?' ELSE '' END END AS parent FROM s)
SELECT document_id, idx, parent AS parent_section FROM p WHERE parent IS NOT NULL AND (document_id, parent) NOT IN (SELECT document_id, title FROM s)""")
def missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sections below the line before; every fourth names a parent that is hardly there."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x))
    rows = _documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), lines.alias("l"), F.posexplode(lines).alias("idx", "title"))
    parent = F.when(F.col("idx") > 0, F.concat(F.get("l", F.col("idx") - 1), F.when(F.col("idx") % 4 == 3, "?").otherwise("")))
    sections = rows.select("document_id", F.col("idx").cast("long").alias("idx"), "title", parent.alias("parent_section"))
    return validation.missing_parents(sections).select("document_id", "idx", "parent_section")


@query("""WITH r AS (SELECT source, count(*) + CASE WHEN source LIKE '%1' THEN 1 ELSE 0 END AS reported FROM documents WHERE source IS NOT NULL GROUP BY source),
f AS (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, reported, coalesce(n, 0) AS found FROM r LEFT JOIN f USING (source) WHERE reported <> coalesce(n, 0)""")
def count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source against those that have a label."""
    docs = _documents(spark, sf_dir)
    reports = docs.where("source IS NOT NULL").groupBy("source").agg((F.count("*") + F.when(F.col("source").endswith("1"), 1).otherwise(0)).alias("n"))
    return validation.count_mismatches(reports, docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id"), "source", "n")


@query("""WITH r AS (SELECT doc_id AS id, n_chars / greatest(length(coalesce(text, '')), 1)::DOUBLE - (doc_id % 3) / 50.0::DOUBLE AS ratio FROM documents)
SELECT id, CASE WHEN ratio BETWEEN 0 AND 1 THEN 'coverage' ELSE 'ratio' END AS rule, 'error' AS severity FROM r WHERE NOT coalesce(ratio BETWEEN 0.99 AND 1, false)""")
def coverage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated lengths against real ones, less some hundredths."""
    ratio = F.col("n_chars") / F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)) - F.col("doc_id") % 3 / 50.0
    return validation.coverage_violations(_documents(spark, sf_dir).select("doc_id", ratio.alias("ratio")), "doc_id")


@query(f"""WITH {CHUNKS}, m AS (SELECT chunk_id, coalesce(chapter_title, 'TBA') AS c, CASE WHEN chunk_id % 5 = 0 THEN ' n/a ' ELSE 'part' END AS s, left(chunk_text, 12) AS summary FROM chunks)
SELECT chunk_id AS id, 'chapter_title_placeholder' AS rule, 'error' AS severity FROM m WHERE lower(trim(c, ' ')) IN ({", ".join(f"'{p}'" for p in validation.METADATA_PLACEHOLDERS)})
UNION ALL SELECT chunk_id, 'section_title_placeholder', 'error' FROM m WHERE chunk_id % 5 = 0
UNION ALL SELECT chunk_id, 'summary_placeholder', 'error' FROM m WHERE lower(trim(summary, ' ')) IN ({", ".join(f"'{p}'" for p in validation.METADATA_PLACEHOLDERS)})
UNION ALL SELECT chunk_id, 'summary_too_short', 'error' FROM m WHERE length(trim(summary, ' ')) < 10""")
def metadata_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), F.coalesce("lang", F.lit("TBA")).alias("chapter_title"), F.when(F.col("doc_id") % 5 == 0, " n/a ").otherwise("part").alias("section_title"),
        F.substring(F.coalesce("text", F.lit("")), 1, 12).alias("summary"),
    )
    return validation.violations(rows, validation.metadata_rules())


@query()
def matched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the middle runs of all documents were found in them."""
    return stats.match_counts(alignment.locate(_documents(spark, sf_dir), middle_runs(spark, sf_dir), 0.85))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^ ]+ *| +') AS w FROM conversations)
SELECT conv_id, turn, 0::BIGINT AS seq, 'metadata' AS type, '{"conv_id":' || conv_id || ',"turn":' || turn || '}' AS content FROM w
UNION ALL SELECT conv_id, turn, 1, 'stage_start', 'generation' FROM w
UNION ALL SELECT conv_id, turn, unnest(range(2, len(w) + 2)), 'token', unnest(w) FROM w
UNION ALL SELECT conv_id, turn, len(w) + 2, 'stage_complete', 'generation' FROM w
UNION ALL SELECT conv_id, turn, len(w) + 3, 'done', NULL FROM w""")
def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as the events of an answer: metadata first, done last."""
    return history.answer_events(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


@query(f"WITH {BM25} SELECT id, bm25 FROM bm25")
def bm25_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in an index that began with their sources as texts, had these replaced by batches, lost some, got them back and was merged."""

    def make(docs: DataFrame, path: str) -> None:
        lexical.add_documents(docs.select("doc_id", F.col("source").alias("text")), path)
        lexical.add_documents(docs, path, replace=True)
        some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
        lexical.delete_documents(some.select(F.col("doc_id").alias("id")), path)
        lexical.add_documents(some, path)
        lexical.merge_generations(spark, path)
        lexical.drop_unused(spark, path)

    return lexical.read_index(spark, stored(spark, sf_dir, "documents", "bm25-changed", "stats/_SUCCESS", make)).scores(TEXT)
