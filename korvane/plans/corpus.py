"""Statistics, validation and chunking over ``documents``, ``labels`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions import text as texts
from korvane.functions.models import overlap_score
from korvane.operators import alignment, chunking, corrective, stats, validation
from korvane.plans.base import CHUNKS, chunks, embedded_chunks, query, table
from korvane.plans.retrieval import COSINE, TEXT, VECTORS, embedded
from korvane.session import small_batches


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).drop("embedding")


@query(f"WITH {CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT source_document) AS n_documents, coalesce(round(avg(token_count), 2), 0) AS avg_tokens FROM chunks")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.table_stats(_plain(spark, sf_dir))


_PROFILE = "SELECT source_document, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens, round(avg(token_count), 2) AS avg_tokens FROM chunks GROUP BY source_document"


@query(f"WITH {CHUNKS} SELECT source_document, n_chunks FROM ({_PROFILE})")
def chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.document_profile(_plain(spark, sf_dir)).select("source_document", "n_chunks").orderBy(F.desc("n_chunks"), "source_document")


@query(f"WITH {CHUNKS} {_PROFILE} ORDER BY n_chunks DESC, source_document LIMIT 10")
def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.document_profile(_plain(spark, sf_dir), 10)


@query(f"WITH {CHUNKS} SELECT source_document, tokens FROM ({_PROFILE})")
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.document_profile(_plain(spark, sf_dir)).select("source_document", "tokens")


@query("SELECT CAST(len(embedding) AS BIGINT) AS dims, count(*) AS n FROM embeddings GROUP BY 1")
def embedding_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.embedding_dims(table(spark, sf_dir, "embeddings"))


@query(f"WITH {CHUNKS}, p AS ({_PROFILE}) SELECT count(*) AS n_documents, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(n_chunks), 6) AS chunks_per_document FROM p")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.batch_report(_plain(spark, sf_dir))


@query("""SELECT CAST(sum((trim(coalesce(text, ''), ' ') <> '')::INT + (trim(coalesce(source, ''), ' ') <> '')::INT + (lang IS NOT NULL AND trim(lang, ' ') <> '')::INT) AS BIGINT) AS complete,
CAST(sum(2 + (lang IS NOT NULL)::INT) AS BIGINT) AS total, round(sum((trim(coalesce(text, ''), ' ') <> '')::INT + (trim(coalesce(source, ''), ' ') <> '')::INT + (lang IS NOT NULL AND trim(lang, ' ') <> '')::INT)::DOUBLE / sum(2 + (lang IS NOT NULL)::INT), 6) AS ratio FROM documents""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.completeness(table(spark, sf_dir, "documents"), ["text", "source"], ["lang"])
    return found.withColumn("complete", F.col("complete").cast("long")).withColumn("total", F.col("total").cast("long"))


@query("""WITH f AS (SELECT doc_id AS vec_id FROM documents), c AS (SELECT (SELECT count(*) FROM f) AS n_files, (SELECT count(*) FROM embeddings) AS n_rows,
(SELECT count(*) FROM f WHERE vec_id NOT IN (SELECT vec_id FROM embeddings)) AS n_missing, (SELECT count(*) FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64) AS n_bad)
SELECT *, n_files = n_rows AND n_missing = 0 AND n_bad = 0 AS valid FROM c""")
def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for the files that should have a vector."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return stats.index_validation(files, table(spark, sf_dir, "embeddings"), 64, "vec_id")


@query("""WITH r AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'ok' WHEN toxic = 1 THEN 'failed' ELSE 'skipped' END AS s FROM labels)
SELECT count(*) FILTER (WHERE s = 'ok') AS n_ok, count(*) FILTER (WHERE s = 'failed') AS n_failed, count(*) FILTER (WHERE s = 'skipped') AS n_skipped,
coalesce(round(100.0 * n_ok::DOUBLE / nullif(n_ok + n_failed, 0), 2), 0) AS success_rate FROM r""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "ok").when(F.col("toxic") == 1, "failed").otherwise("skipped")
    return stats.index_stats(table(spark, sf_dir, "labels").withColumn("status", status))


_GRADES = """g AS (SELECT source, coalesce(TRY_CAST(CASE WHEN quality IS NULL THEN 'none' WHEN toxic = 1 THEN '0.1' ELSE '0.' || (5 + 4 * quality) END AS DOUBLE), 0.5) AS g FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"""WITH {_GRADES}, a AS (SELECT source, round(avg(g), 6) AS quality, count(*) FILTER (WHERE g >= 0.5) AS n_kept, avg(g) FILTER (WHERE g >= 0.5) AS m FROM g GROUP BY source)
SELECT source, quality, n_kept, CASE WHEN n_kept > 0 THEN round(0.7 * m + 0.3 * least(n_kept / 5.0::DOUBLE, 1.0), 6) ELSE 0.0 END AS confidence FROM a""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as grades of a source's documents; those without a label have a grade that can't be read."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    grade = F.when(F.col("quality").isNull(), "none").when(F.col("toxic") == 1, "0.1").otherwise(F.concat(F.lit("0."), 5 + 4 * F.col("quality")))
    return stats.retrieval_quality(rows.select("source", grade.alias("grade")), "source")


_NUMBERED = f"{CHUNKS}, n AS (SELECT *, source_document || '_chunk_' || format('{{:03d}}', chunk_id) AS name, left(chunk_text, 600) AS summary FROM chunks)"


@query(f"""WITH {_NUMBERED}, v AS (
  SELECT name AS id, 'chunk_text' AS rule, 'error' AS severity FROM n WHERE trim(chunk_text, ' ') = ''
  UNION ALL SELECT name, 'token_count', 'error' FROM n WHERE token_count < 1
  UNION ALL SELECT name, 'too_long', 'error' FROM n WHERE token_count > 1000
  UNION ALL SELECT name, 'summary_length', 'warning' FROM n WHERE NOT length(summary) BETWEEN 10 AND 500
  UNION ALL SELECT name, 'summary_placeholder', 'warning' FROM n WHERE lower(trim(summary, ' ')) IN ({", ".join(f"'{p}'" for p in validation.PLACEHOLDERS)})
) SELECT * FROM v""")
def validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each violation; the text's start stands for a summary."""
    rows = _plain(spark, sf_dir).withColumn("summary", F.substring("chunk_text", 1, 600)).withColumn("chunk_id", F.format_string("%s_chunk_%03d", "source_document", "chunk_id"))
    return validation.violations(rows, validation.chunk_rules())


_SECTIONS = r"""sec AS (SELECT doc_id AS document_id, i - 1 AS idx, lines[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, unnest(range(1, len(lines) + 1)) AS i FROM documents)),
named AS (SELECT document_id, idx, 'T' || (idx % 7) AS title, CASE WHEN idx % 7 = 0 THEN 1 ELSE 2 END AS level, CASE WHEN idx % 7 = 0 THEN NULL ELSE 'T0' END AS parent_section, left(trim(line, ' '), 20) AS start_words FROM sec)"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sections: every seventh is a chapter, the others are its children."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "line"))
    top = F.col("idx") % 7 == 0
    return rows.select(
        "document_id", F.col("idx").cast("long").alias("idx"), F.concat(F.lit("T"), F.col("idx") % 7).alias("title"), F.when(top, 1).otherwise(2).alias("level"),
        F.when(~top, "T0").alias("parent_section"), F.substring(F.btrim("line"), 1, 20).alias("start_words"), F.lit("").alias("end_words"),
    )


@query(f"""WITH {_SECTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY idx) AS i FROM named WHERE start_words <> '')
SELECT document_id, idx, CAST(document_id AS VARCHAR) || '_chunk_' || format('{{:03d}}', i) AS chunk_id FROM k""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_ids(_sections(spark, sf_dir)).select("document_id", "idx", "chunk_id")


@query(f"""WITH {_SECTIONS}, c AS (SELECT document_id, string_agg(title, ',' ORDER BY idx) AS t FROM named WHERE level = 2 GROUP BY document_id)
SELECT n.document_id, idx, 'T0' AS chapter_title, CASE WHEN level = 1 THEN coalesce(t, '') ELSE '' END AS children FROM named n LEFT JOIN c USING (document_id)""")
def derive_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.derive_metadata(_sections(spark, sf_dir)).select("document_id", "idx", "chapter_title", F.array_join("subsection_title", ",").alias("children"))


@query(f"""WITH {CHUNKS}, w AS (SELECT chunk_id, coalesce(nullif(concat_ws(' > ', nullif(source_document, ''), nullif(chapter_title, '')), ''), 'Unknown Source') || chr(10) || chr(10) || chunk_text AS t FROM chunks)
SELECT chunk_id, sha256(t) AS text_sha256, CAST(length(t) // 4 AS BIGINT) AS tokens FROM w""")
def build_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _plain(spark, sf_dir)
    whole = chunking.chunk_text(texts.breadcrumb(F.col("source_document"), F.col("chapter_title")), F.col("chunk_text"))
    return rows.select("chunk_id", F.sha2(whole, 256).alias("text_sha256"), texts.token_count(whole).cast("long").alias("tokens"))


@query("SELECT doc_id, 'structure_' || sha256(coalesce(text, '')) AS key FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chunking.cache_key("structure", F.coalesce("text", F.lit(""))).alias("key"))


@query("SELECT doc_id, source AS title, lang, '' AS missing FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, source, NULL, 'LANG' FROM documents WHERE lang IS NULL")
def parse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.concat(F.lit("[TITLE]"), "source", F.lit("[/TITLE]\n"), F.coalesce(F.concat(F.lit("[LANG] "), "lang", F.lit(" [/LANG]")), F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", tagged.alias("tagged"))
    return chunking.parse_tags(rows, ["TITLE", "LANG"], "tagged").select("doc_id", "title", "lang", F.array_join("missing_tags", ",").alias("missing"))


@query(f"""WITH {CHUNKS} SELECT chunk_id, CASE WHEN x >= 0.95 THEN 'high' WHEN x >= 0.9 THEN 'medium' WHEN x >= 0.85 THEN 'low' ELSE 'gap' END AS class,
CASE WHEN 100 * x >= 95 THEN 'high' WHEN 100 * x >= 80 THEN 'medium' ELSE 'low' END AS coverage
FROM (SELECT chunk_id, token_count % 101 / 100.0::DOUBLE AS x FROM chunks)""")
def similarity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("token_count") % 101 / 100.0
    return _plain(spark, sf_dir).select("chunk_id", texts.similarity_class(share, 0.85).alias("class"), texts.coverage_class(100 * share).alias("coverage"))


@query(r"SELECT conv_id, turn, CASE WHEN lower(x) IN ('retrieve', 'respond') THEN lower(x) ELSE 'retrieve' END AS intent FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'respond' ELSE role END AS x FROM conversations)")
def normalize_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit(" '"), F.upper(F.when(F.col("role") == "user", "respond").otherwise(F.col("role"))), F.lit("'\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.intent_or_default(said).alias("intent"))


@query(f"WITH {CHUNKS} SELECT chunk_id, token_count FROM chunks")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), texts.token_count(F.col("text")).cast("long").alias("token_count"))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS hits, count(*) FILTER (WHERE event_type = 'click') AS misses FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN hits + misses > 0 THEN round(hits::DOUBLE / (hits + misses), 6) ELSE 0.0 END AS hit_rate, hits * 1500 AS tokens_saved,
CASE WHEN hits > 0 THEN round(hits * 5000.0::DOUBLE / (misses * 1500 + hits * 5000), 6) ELSE 0.0 END AS saved_share FROM c""")
def cache_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as hits and clicks as misses of a cache."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(n("view").alias("hits"), n("click").alias("misses"))
    rate, saved = stats.cache_savings(F.col("hits"), F.col("misses"), 1500)
    share = stats.token_savings(F.col("hits"), F.col("misses") * 1500)
    return counts.select("user_id", F.round(rate, 6).alias("hit_rate"), saved.alias("tokens_saved"), F.round(share, 6).alias("saved_share"))


@query("""WITH a AS (SELECT source, avg(quality::DOUBLE) AS m, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY source)
SELECT source, round(0.7 * m + 0.3 * least(n / 5.0::DOUBLE, 1.0), 6) AS confidence FROM a""")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 0"), "doc_id")
    means = rows.groupBy("source").agg(F.avg(F.col("quality").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.select("source", stats.answer_confidence(F.col("m"), F.col("n")).alias("confidence"))


_TSV = """tsv AS (SELECT document_id, idx, title, level, parent_section, 'about ' || title AS summary, CASE WHEN start_words = '' THEN '' ELSE left(sha256(line), 8) END AS start_words FROM named JOIN sec USING (document_id, idx))"""


def _responses(spark: SparkSession, sf_dir: str, fields: tuple[str, ...]) -> DataFrame:
    """The sections of each document as a response: tab-separated lines after a header, in a fence."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "line"))
    top = F.col("idx") % 7 == 0
    cells = {
        "title": F.concat(F.lit("T"), F.col("idx") % 7), "level": F.when(top, "1").otherwise("2"), "parent_section": F.when(top, "ROOT").otherwise("T0"),
        "summary": F.concat(F.lit("about T"), F.col("idx") % 7), "start_words": F.when(F.btrim("line") == "", "[EMPTY]").otherwise(F.substring(F.sha2("line", 256), 1, 8)),
        "end_words": F.lit("[EMPTY]"), "is_table": F.lit("False"),
    }
    lines = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.concat_ws("\t", *[cells[f] for f in fields]).alias("t")))).alias("ts"))
    header = F.lit("```\n" + "\t".join(fields).replace("parent_section", "parent") + "\n")
    return lines.select("document_id", F.concat(header, F.array_join(F.transform("ts", lambda x: x["t"]), "\n"), F.lit("\n```")).alias("text"))


@query(f"WITH {_SECTIONS}, {_TSV} SELECT document_id, idx, title, level, parent_section, summary, start_words, '' AS end_words, false AS is_table FROM tsv")
def parse_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.parse_structure(_responses(spark, sf_dir, chunking.FIELDS)).withColumn("idx", F.col("idx").cast("long"))


@query(f"WITH {_SECTIONS}, {_TSV} SELECT document_id, idx, title, level, parent_section, summary FROM tsv")
def parse_structure_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = chunking.parse_structure(_responses(spark, sf_dir, chunking.FIELDS_V1), fields=chunking.FIELDS_V1)
    return parsed.withColumn("idx", F.col("idx").cast("long"))


@query(f"""WITH {_SECTIONS}, picked AS (SELECT * FROM named WHERE idx % 3 <> 0 OR document_id % 5 = 0)
SELECT document_id, coalesce(arg_min(title, idx) FILTER (WHERE level = 1), arg_min(title, idx)) AS chapter_title FROM picked GROUP BY document_id""")
def chapter_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of most documents only some sections count, so that not all have a chapter."""
    return chunking.chapter_titles(_sections(spark, sf_dir).where("idx % 3 <> 0 OR document_id % 5 = 0"))


@query("""SELECT doc_id, coalesce(source, '') AS chapter_title, coalesce(lang, '') AS section_title, CASE WHEN doc_id % 3 > 0 THEN 'part ' || doc_id % 3 END AS subsection_title, 'about ' || doc_id AS summary,
CASE WHEN doc_id % 4 = 0 THEN 'length' WHEN doc_id % 4 = 1 THEN 'start' END AS prefix_problem FROM documents""")
def parse_chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("part "), F.col("doc_id") % 3)).otherwise("none")
    blank = F.lit("")
    line = F.concat_ws("\t", F.coalesce("source", blank), F.concat(F.lit(" "), F.coalesce("lang", blank)), part, F.concat(F.lit("about "), F.col("doc_id"), F.lit("\n")))
    prefix = F.when(F.col("doc_id") % 4 == 0, "This chunk").when(F.col("doc_id") % 4 == 1, "A chunk that is from the start").otherwise("This chunk is from the middle")
    rows = table(spark, sf_dir, "documents").select("doc_id", chunking.chunk_metadata(line).alias("m"), chunking.prefix_problem(prefix).alias("prefix_problem"))
    return rows.select("doc_id", "m.*", "prefix_problem")


@query(r"""WITH t AS (
  SELECT doc_id, '[TITLE]' || replace(replace(replace(coalesce(text, ''), '.', '[/TITLE]'), ',', '[LANG]'), chr(10), '[/LANG]') || CASE WHEN contains(text, '@') THEN '[NOTE]' ELSE '' END AS t FROM documents
), m AS (SELECT doc_id, t, n, regexp_extract_all(t, '\[/?' || n || '\]') AS marks FROM t, (VALUES ('TITLE'), ('LANG')) v(n)),
e AS (SELECT doc_id, n, i, sum(CASE WHEN mark LIKE '[/%' THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id, n ORDER BY i) AS depth FROM (SELECT doc_id, n, unnest(marks) AS mark, unnest(range(len(marks))) AS i FROM m)),
d AS (SELECT doc_id, n, min(depth) AS least, arg_max(depth, i) AS last, count(*) AS k FROM e GROUP BY doc_id, n),
p AS (SELECT m.doc_id, CASE WHEN k IS NULL THEN 'missing ' WHEN last <> 0 THEN 'uneven ' WHEN least < 0 THEN 'unordered ' END || m.n AS problem FROM m LEFT JOIN d USING (doc_id, n)
  UNION ALL SELECT doc_id, 'unexpected ' || x FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '\[(\w+)\]', 1))) AS x FROM t) WHERE x NOT IN ('TITLE', 'LANG'))
SELECT doc_id, coalesce(string_agg(problem, ', ' ORDER BY problem), '') AS problems FROM p GROUP BY doc_id""")
def validate_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as answers: a title that each full stop closes, commas open a language and ends of lines close it."""
    tagged = F.coalesce("text", F.lit(""))
    for mark, name in ((".", "[/TITLE]"), (",", "[LANG]"), ("\n", "[/LANG]")):
        tagged = F.replace(tagged, F.lit(mark), F.lit(name))
    tagged = F.concat(F.lit("[TITLE]"), tagged, F.when(F.contains("text", F.lit("@")), "[NOTE]").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(chunking.tag_problems(tagged, ["TITLE", "LANG"]), ", ").alias("problems"))


@query(f"""WITH {_NUMBERED}, r AS (SELECT name, chapter_title, CASE WHEN chunk_id % 4 > 0 THEN 'part' END AS section_title, CASE WHEN chunk_id % 3 > 0 THEN 'about' END AS about, token_count FROM n), v AS (
  SELECT name AS id, 'chapter_title' AS rule, 'error' AS severity FROM r WHERE coalesce(chapter_title, '') = ''
  UNION ALL SELECT name, 'section_title', 'error' FROM r WHERE section_title IS NULL
  UNION ALL SELECT name, 'summary', 'warning' FROM r WHERE about IS NULL
  UNION ALL SELECT name, 'too_long', 'error' FROM r WHERE token_count > 1000
) SELECT count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings, count(*) = 0 AS passed FROM v""")
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished table as a whole, where a warning fails too."""
    rows = _plain(spark, sf_dir).select(
        F.format_string("%s_chunk_%03d", "source_document", "chunk_id").alias("chunk_id"), "chapter_title", F.when(F.col("chunk_id") % 4 > 0, "part").alias("section_title"),
        F.when(F.col("chunk_id") % 3 > 0, "about").alias("summary"), "token_count",
    )
    return validation.outcome(validation.violations(rows, validation.document_rules()), strict=True)


@query(f"""WITH {_SECTIONS}, v AS (SELECT document_id || '/' || idx AS id, title, level, line FROM named JOIN sec USING (document_id, idx))
SELECT id, 'start_words' AS rule, 'error' AS severity FROM v WHERE length(line) > 1000 UNION ALL SELECT id, 'summary_length', 'error' FROM v WHERE length(line) > 3000 OR line = ''
UNION ALL SELECT id, 'summary_short', 'warning' FROM v WHERE length(line) < 10""")
def validate_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sections that are their own summary and hint."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "line"))
    sections = rows.select(
        F.concat_ws("/", "doc_id", "idx").alias("chunk_id"), F.lit("T").alias("title"), F.lit(2).alias("level"), F.col("line").alias("summary"), F.col("line").alias("start_words"),
        F.lit("").alias("end_words"),
    )
    return validation.violations(sections, validation.section_rules())


@query("SELECT count(*) AS n_videos, CAST(sum(n) AS BIGINT) AS seconds, CAST(sum(n) // 3600 AS BIGINT) AS hours, CAST(sum(n) % 3600 // 60 AS BIGINT) AS minutes FROM (SELECT conv_id, 60 * count(*) AS n FROM conversations GROUP BY conv_id)")
def total_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A minute for each turn."""
    return stats.total_duration(table(spark, sf_dir, "conversations").groupBy("conv_id").agg((60 * F.count("*")).alias("duration")))


# --- by Python in tasks: held against brute force in the tests ------------------------------------------------------------


@query()
def parent_child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.parent_child_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def split_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(chunking.split_recursive(F.col("text"), 600, 120)).alias("piece_no", "text"))


def _runs(spark: SparkSession, sf_dir: str, starts: str = "sequence(0, greatest(size(w) - 1, 0), 60)") -> DataFrame:
    """(doc_id, chunk_no, text): each document without every tenth word, cut after every 60 words; all runs, or those of some starts."""
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda _, i: i % 10 != 9)
    rows = table(spark, sf_dir, "documents").select("doc_id", kept.alias("w"))
    return rows.select("doc_id", "w", F.explode(F.expr(f"transform({starts}, a -> int(a))")).alias("a")).select("doc_id", F.floor(F.col("a") / 60).alias("chunk_no"), F.array_join(F.slice("w", F.col("a") + 1, 60), " ").alias("text"))


@query(r"""WITH t AS (
  SELECT doc_id, lower(coalesce(text, '')) AS whole, lower(list_aggregate(list_filter(string_split(coalesce(text, ''), ' '), lambda x, i: i % 10 <> 0), 'string_agg', ' ')) AS given FROM documents
), c AS (
  SELECT doc_id, w, 1 AS own, 0 AS given FROM (SELECT doc_id, unnest(regexp_extract_all(whole, '[\p{L}\p{N}_]+')) AS w FROM t)
  UNION ALL SELECT doc_id, w, 0, 1 FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(given, ''), '[\p{L}\p{N}_]+')) AS w FROM t)
), s AS (SELECT doc_id, w, sum(own) AS own, sum(given) AS given FROM c GROUP BY doc_id, w),
d AS (SELECT doc_id, sum(least(own, given)) AS shared, sum(own) AS own, sum(given) AS given FROM s GROUP BY doc_id)
SELECT doc_id, round(coalesce(2.0::DOUBLE * shared / (own + given), 1.0), 6) AS ratio, CAST(coalesce(own - shared, 0) AS BIGINT) AS n_missing, CAST(coalesce(given - shared, 0) AS BIGINT) AS n_added
FROM documents LEFT JOIN d USING (doc_id)""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is given back by runs of its words that lack some."""
    return alignment.coverage_ratio(table(spark, sf_dir, "documents"), _runs(spark, sf_dir))


def middle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir, "array((greatest(size(w) - 1, 0) div 60) div 2 * 60)")


@query()
def fuzzy_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the middle run of each document lies in it."""
    return alignment.locate(table(spark, sf_dir, "documents"), middle_runs(spark, sf_dir))


def _tries() -> str:
    """The three tries of a query in SQL, each with half of the words of the one before."""
    parts, text = [], TEXT
    for i in range(corrective.REWRITES + 1):
        words = "[" + ", ".join(f"'{w}'" for w in sorted(set(text.split()))) + "]"
        grade = rf"round(len(list_intersect({words}, regexp_split_to_array(lower(chunk_text), '\s+'))) / {len(set(text.split()))}.0::DOUBLE, 6)"
        parts.append(f"""f{i} AS (SELECT {i} AS try, '{text}' AS query, chunk_id, {COSINE.format(a="e", b=embedded(text))} AS similarity_score, {grade} AS grade FROM v ORDER BY similarity_score DESC NULLS LAST, chunk_id LIMIT 10)""")
        text = corrective.first_words(text, i)
    return ", ".join(parts)


@query(f"""WITH {VECTORS}, {_tries()}, f AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2),
s AS (SELECT try, avg(grade) AS mean, count(*) FILTER (WHERE grade >= {corrective.KEEP}) AS n, avg(grade) FILTER (WHERE grade >= {corrective.KEEP}) AS kept_mean FROM f GROUP BY try),
c AS (SELECT try, CASE WHEN n > 0 THEN round(0.7 * kept_mean + 0.3 * least(n / 5.0::DOUBLE, 1.0), 6) ELSE 0.0 END AS confidence FROM s
  WHERE try = coalesce((SELECT min(try) FROM s WHERE mean >= {corrective.GOOD} AND n > 0), {corrective.REWRITES}))
SELECT chunk_id, similarity_score, grade, grade >= {corrective.KEEP} AS kept, confidence, CASE WHEN confidence >= {corrective.ANSWER} THEN 'answer' ELSE 'insufficient' END AS outcome, query
FROM f JOIN c USING (try)""".replace("try", "attempt"))
def corrective_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corrective.corrective_search(embedded_chunks(spark, sf_dir), TEXT, 10, overlap_score)
    return found.select("chunk_id", "similarity_score", "grade", "kept", "confidence", "outcome", "query")
