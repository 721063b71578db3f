"""History, routing and transcripts over ``conversations``: a conversation stands for a transcript, its role for the speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions import text as texts
from korvane.operators import chunking, coverage, history, stats, transcript
from korvane.plans.base import query, table

_ROWS = "m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, {g} ORDER BY turn DESC) AS back FROM conversations)"
_USER = "u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ({roles}))"
_ALL = "a AS (SELECT DISTINCT conv_id FROM conversations)"


@query(f"WITH {_USER.format(roles="'user', 'human'")} SELECT conv_id, turn, CAST(back AS BIGINT) AS back FROM u WHERE back <= 2")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.tail(table(spark, sf_dir, "conversations"), ("user", "human"), 2).select("conv_id", "turn", F.col("back").cast("long").alias("back"))


@query(f"""WITH {_ALL}, {_USER.format(roles="'user', 'human'")}, q AS (
  SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS query FROM u WHERE back <= 3 GROUP BY conv_id)
SELECT conv_id, coalesce(query, '') AS query FROM a LEFT JOIN q USING (conv_id)""")
def retrieval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.retrieval_query(table(spark, sf_dir, "conversations"), 3)


@query(f"""WITH {_ALL}, {_USER.format(roles="'user', 'human', 'assistant', 'ai'")}, c AS (
  SELECT conv_id, string_agg((CASE WHEN role IN ('user', 'human') THEN 'User' ELSE 'Assistant' END) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS context
  FROM u WHERE back <= 5 AND back > 1 GROUP BY conv_id)
SELECT conv_id, coalesce(context, '') AS context FROM a LEFT JOIN c USING (conv_id)""")
def context_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.context(table(spark, sf_dir, "conversations"), 5, 1)


def _contains(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(low, '{w}')" for w in words)


_CLASSIFIED = f"""k AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS low FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, CASE WHEN {_contains(history.EMOTIONAL)} THEN 'emotional_support' ELSE 'rag_agent' END AS agent,
      CASE WHEN regexp_matches(low, '\\b({"|".join(history.GREETINGS)})\\b') THEN 'respond' ELSE 'retrieve' END AS intent FROM k)"""


@query(f"WITH {_CLASSIFIED} SELECT * FROM r")
def classify_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.classify_messages(table(spark, sf_dir, "conversations"))


@query(f"WITH {_ALL}, {_CLASSIFIED}, t AS (SELECT conv_id, arg_max(agent, turn) AS agent FROM r GROUP BY conv_id) SELECT conv_id, coalesce(agent, 'supervisor') AS agent FROM a LEFT JOIN t USING (conv_id)")
def sticky_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    routed = rows.join(history.classify_messages(rows).select("conv_id", "turn", "agent"), ["conv_id", "turn"], "left")
    return history.sticky_agent(routed)


@query(f"""WITH {_ALL}, h AS (SELECT conv_id, string_agg((CASE WHEN role IN ('user', 'human') THEN 'User' WHEN role IN ('assistant', 'ai') THEN 'Assistant' ELSE 'Unknown' END) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history
FROM conversations WHERE coalesce(role, '') <> 'system' GROUP BY conv_id) SELECT conv_id, coalesce(history, 'No prior messages available.') AS history FROM a LEFT JOIN h USING (conv_id)""")
def full_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.full_history(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS seq, turn, coalesce(role, '') AS role FROM conversations WHERE turn % 4 <> 3")
def sse_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as server-sent events, every fourth a comment, cut into chunks in the middle of each."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"))
    frame = F.when(F.col("turn") % 4 == 3, F.lit(": keep-alive\n\n")).otherwise(texts.sse_encode(F.struct("turn", "role")))
    halves = F.array(F.substring(frame, 1, 9), F.substring(frame, F.lit(10), F.length(frame)))
    chunks = rows.select("conv_id", F.posexplode(halves).alias("half", "chunk"), "turn").withColumn("at", 2 * F.col("turn") + F.col("half"))
    found = history.decode_chunks(chunks, "conv_id", "at", "chunk")
    return found.select("conv_id", F.col("seq").cast("long").alias("seq"), F.from_json("event", "turn long, role string").alias("e")).select("conv_id", "seq", "e.*")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND event_id % 5 <> 0 AND event_id % 7 <> 0")
def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as tokens of nodes that talk to the user; every fifth is internal, every seventh empty."""
    node = F.when(F.col("event_type") == "view", "respond").when(F.col("event_type") == "click", "rag_agent").otherwise("supervisor")
    tags = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("x"), F.lit(texts.INTERNAL))).otherwise(F.array(F.lit("x")))
    token = F.when(F.col("event_id") % 7 != 0, "t").otherwise("")
    return table(spark, sf_dir, "events").where(texts.shown_to_user(node, tags, token)).select("event_id")


_PREFIXED = "CASE turn % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN '```' || coalesce(text, '') WHEN 2 THEN 'Here is ' || coalesce(text, '') ELSE '   ' END"


@query(f"""SELECT conv_id, turn, CASE WHEN trim(x, ' ') = '' THEN 'empty' WHEN starts_with(trim(x, ' '), '```') THEN 'fenced' WHEN regexp_matches(lower(trim(x, ' ')), '^here (is|are)') THEN 'chatty' END AS problem
FROM (SELECT conv_id, turn, {_PREFIXED} AS x FROM conversations)""")
def validate_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, text = F.col("turn") % 4, F.coalesce("text", F.lit(""))
    said = F.when(kind == 0, text).when(kind == 1, F.concat(F.lit("```"), text)).when(kind == 2, F.concat(F.lit("Here is "), text)).otherwise("   ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chunking.response_problem(said).alias("problem"))


# --- transcripts ------------------------------------------------------------------------------------------------------

_CAPTIONS = "cap AS (SELECT conv_id, turn, nullif(role, 'system') AS speaker, coalesce(text, '') AS text FROM conversations)"
_OFFSETS = f"{_CAPTIONS}, o AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM cap), off AS (SELECT *, char_start + length(text) AS char_end FROM o)"


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    speaker = F.nullif(F.col("role"), F.lit("system"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"""WITH {_CAPTIONS}, f AS (
  SELECT *, first_value(speaker) OVER w AS s0, last_value(speaker IGNORE NULLS) OVER w AS filled FROM cap
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
), c AS (
  SELECT *, CASE WHEN s0 IS NOT NULL AND filled <> lag(filled) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM f
), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c)
SELECT conv_id, run AS merged, min(turn) AS first, max(turn) AS last, arg_min_null(speaker, turn) AS speaker, string_agg(text, ' ' ORDER BY turn) AS text
FROM r GROUP BY conv_id, run""")
def merge_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _captions(spark, sf_dir).withColumnRenamed("turn", "idx")
    return transcript.merge_speakers(rows, "conv_id", "idx").withColumnRenamed("turn", "merged")


@query(f"WITH {_OFFSETS} SELECT conv_id, turn, char_start, char_end FROM off")
def char_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.with_offsets(_captions(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "char_start", "char_end")


_STRIDE = 300
_RANGES = f"{_OFFSETS}, len AS (SELECT conv_id, max(char_end) AS length FROM off GROUP BY conv_id), rg AS (SELECT conv_id, s AS start, s + {_STRIDE} AS \"end\" FROM (SELECT conv_id, unnest(range(0, length + 1, {_STRIDE})) AS s FROM len))"


_SPOKEN = """sp AS (SELECT conv_id, start, "end", min(turn) AS first, max(turn) AS last, coalesce(string_agg(DISTINCT speaker, ',' ORDER BY speaker), '') AS speakers
FROM rg JOIN off USING (conv_id) WHERE char_end > start AND char_start < "end" GROUP BY conv_id, start, "end"),
ends AS (SELECT conv_id, min(turn) AS all_first, max(turn) AS all_last FROM off GROUP BY conv_id)"""


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = transcript.with_offsets(_captions(spark, sf_dir), "conv_id", "turn")
    lengths = rows.groupBy("conv_id").agg(F.max("char_end").alias("length"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length"), F.lit(_STRIDE).cast("long")))
    return lengths.select("conv_id", starts.alias("start")).withColumn("end", F.col("start") + _STRIDE), rows


@query(f"""WITH {_RANGES}, {_SPOKEN} SELECT conv_id, start, "end", coalesce(speakers, '') AS speakers FROM rg LEFT JOIN sp USING (conv_id, start, "end")""")
def chunk_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.times_and_speakers(*_ranges(spark, sf_dir), "conv_id", "turn").select("conv_id", "start", "end", "speakers")


@query(f"""WITH {_RANGES}, {_SPOKEN} SELECT conv_id, start, "end", coalesce(first, all_first) AS first, coalesce(last, all_last) AS last, coalesce(speakers, '') AS speakers
FROM rg LEFT JOIN sp USING (conv_id, start, "end") LEFT JOIN ends USING (conv_id)""")
def chunk_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of fixed length with their first and last caption and their speakers."""
    return transcript.times_and_speakers(*_ranges(spark, sf_dir), "conv_id", "turn")


@query(r"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN role ELSE nullif(trim(regexp_extract(coalesce(text, ''), '^([A-Za-z\s]+):\s*', 1)), '') END AS speaker FROM conversations""")
def speaker_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms of a speaker's name, and texts as they are."""
    text = F.coalesce("text", F.lit(""))
    line = F.when(F.col("turn") % 3 == 0, F.concat("role", F.lit(": "), text)).when(F.col("turn") % 3 == 1, F.concat(F.lit("<v "), "role", F.lit(">"), text)).otherwise(text)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", transcript.speaker_of(line).alias("speaker"))


@query("""SELECT conv_id, turn, nullif(regexp_extract(line, '^([A-Za-z\\s]+):\\s*', 1), '') AS speaker, regexp_replace(regexp_replace(line, '^[A-Za-z\\s]+:\\s*', ''), '\\s+', ' ', 'g') AS clean
FROM (SELECT conv_id, turn, role || ': ' || trim(regexp_replace(coalesce(text, ''), '[<>:\\s]+', ' ', 'g')) AS line FROM conversations)""")
def caption_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("role", F.lit(": "), F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[<>:\s]+", " ")))
    rows = table(spark, sf_dir, "conversations").withColumn("line", line)
    return rows.select("conv_id", "turn", transcript.speaker_of(F.col("line")).alias("speaker"), transcript.clean_caption(F.col("line")).alias("clean"))


@query("""SELECT conv_id, count(*) AS n_parts, max(turn) - min(turn) AS duration, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers, arg_min(role, turn) AS title
FROM conversations GROUP BY conv_id""")
def video_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.catalog(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn", "turn", "role", "role")


@query("SELECT conv_id, turn, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS global_id FROM conversations")
def global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.renumber(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])


# --- coverage: what the users' turns cover of the whole transcript --------------------------------------------------------

_GAPS = f"""{_OFFSETS}, len AS (SELECT conv_id, max(char_end) AS length FROM off GROUP BY conv_id), iv AS (SELECT conv_id, char_start AS s, char_end AS e FROM off WHERE speaker = 'user'),
w AS (SELECT *, coalesce(max(e) OVER (PARTITION BY conv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM iv),
gap AS (SELECT conv_id, reach AS start, s AS "end" FROM w WHERE s > reach
  UNION ALL SELECT conv_id, coalesce(mx, 0), length FROM len LEFT JOIN (SELECT conv_id, max(e) AS mx FROM iv GROUP BY conv_id) USING (conv_id) WHERE coalesce(mx, 0) < length)"""


def _covered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = transcript.with_offsets(_captions(spark, sf_dir), "conv_id", "turn")
    intervals = rows.where("speaker = 'user'").select("conv_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    return intervals, rows.groupBy("conv_id").agg(F.max("char_end").alias("length"))


@query(f'WITH {_GAPS} SELECT conv_id, start, "end" FROM gap')
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.gaps(*_covered(spark, sf_dir), "conv_id")


@query(f"""WITH {_GAPS} SELECT conv_id, s AS start, e AS "end", 'covered' AS type FROM iv UNION ALL SELECT conv_id, start, "end", 'gap' FROM gap""")
def coverage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_map(*_covered(spark, sf_dir), "conv_id")


@query(f"""WITH {_GAPS}, t AS (SELECT conv_id, sum("end" - start) AS open, count(*) AS n_gaps, count(*) FILTER (WHERE "end" - start > {coverage.SIGNIFICANT}) AS n_significant FROM gap GROUP BY conv_id)
SELECT conv_id, length, CAST(length - coalesce(open, 0) AS BIGINT) AS covered, CASE WHEN length = 0 THEN 100.0 ELSE round(100.0 * (length - coalesce(open, 0))::DOUBLE / length, 2) END AS percent,
       coalesce(n_gaps, 0) AS n_gaps, coalesce(n_significant, 0) AS n_significant FROM len LEFT JOIN t USING (conv_id)""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.summary(*_covered(spark, sf_dir), "conv_id")
