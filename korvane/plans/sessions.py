"""Sessions and streams over ``events``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.operators import ingest, sessions, versions
from korvane.plans.base import query, table

NOW, TTL = datetime(2024, 1, 30), 86_400
ENDS = ("error",)
_LATEST = "latest AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id), s AS (SELECT e.user_id, e.event_id, e.event_type, e.ts AS updated_at FROM events e JOIN latest USING (user_id, event_id))"
_LIVE = f"live AS (SELECT * FROM s WHERE updated_at >= TIMESTAMP '{NOW}' - INTERVAL {TTL} SECONDS)"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user, as their last event left it."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("updated_at"))
    return sessions.latest(rows, "user_id", ["event_id"]).withColumn("session_id", F.col("user_id"))


@query(f"WITH {_LATEST} SELECT user_id, event_id, event_type, updated_at FROM s")
def session_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select("user_id", "event_id", "event_type", "updated_at")


@query(f"WITH {_LATEST}, {_LIVE} SELECT user_id, event_id FROM live")
def session_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.live(_sessions(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), TTL).select("user_id", "event_id")


@query(f"WITH {_LATEST}, {_LIVE} SELECT user_id FROM s WHERE user_id NOT IN (SELECT user_id FROM live)")
def session_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.expired(_sessions(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), TTL).select("user_id")


@query(f"SELECT event_id AS session_id, ts AS updated_at FROM events WHERE user_id = 8 AND ts >= TIMESTAMP '{NOW}' - INTERVAL {TTL} SECONDS")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event taken as a session of its user."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("session_id"), F.col("ts").alias("updated_at"))
    return sessions.of_user(rows, 8, F.lit(NOW).cast("timestamp_ntz"), TTL).drop("user_id")


@query(f"""WITH {_LATEST}, {_LIVE} SELECT e.event_id AS request_id, e.user_id AS session_id,
CASE WHEN l.user_id IS NULL THEN 'created' WHEN l.user_id = e.user_id - e.event_id % 2 THEN 'loaded' ELSE 'forbidden' END AS outcome
FROM events e LEFT JOIN live l ON l.user_id = e.user_id""")
def session_create_or_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second request comes from somebody else."""
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("session_id"), (F.col("user_id") - F.col("event_id") % 2).alias("user_id"))
    return sessions.create_or_load(requests, _sessions(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), TTL)


@query("""WITH ends AS (SELECT user_id, min(event_id) AS e FROM events WHERE event_type = 'error' GROUP BY user_id),
rows AS (SELECT v.* FROM events v LEFT JOIN ends USING (user_id) WHERE e IS NULL OR event_id <= e)
SELECT user_id, coalesce(string_agg(CASE WHEN event_type = 'view' THEN CAST(event_id AS VARCHAR) END, '' ORDER BY event_id), '') AS answer,
       count(*) FILTER (WHERE event_type = 'view') AS n_tokens, arg_max(event_type, event_id) FILTER (WHERE event_type IN ('signup', 'purchase')) AS stage,
       CASE WHEN bool_or(event_type = 'error') THEN 'error' ELSE 'open' END AS status
FROM rows GROUP BY user_id""")
def stream_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are tokens, sign-ups and purchases stages, an error ends the stream."""
    kind = F.col("event_type")
    token = F.when(kind == "view", F.col("event_id").cast("string"))
    stage = F.when(kind.isin("signup", "purchase"), kind)
    return sessions.accumulate(table(spark, sf_dir, "events"), "user_id", "event_id", token, stage, "event_type", ENDS)


@query("""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS starts, max(ts) AS ends, count(*) AS n FROM r GROUP BY user_id, run""")
def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "2 hours")


@query("""WITH have AS (SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 3 = 0),
f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT user_id, event_id FROM f WHERE i = 1 AND user_id NOT IN (SELECT user_id FROM have)""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    there = rows.where("event_type = 'signup' AND event_id % 3 = 0").select("user_id").distinct()
    return ingest.absent(rows.select("user_id", "event_id"), there, "user_id", ["event_id"])


@query("""WITH new AS (SELECT user_id AS key, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id),
old AS (SELECT user_id AS key, min(value) AS value FROM events GROUP BY user_id)
SELECT key, value FROM new UNION ALL SELECT key, value FROM old WHERE key NOT IN (SELECT key FROM new)""")
def upsert_key_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("user_id", "key")
    old = rows.groupBy("key").agg(F.min("value").alias("value"))
    new = rows.where("event_type = 'purchase'").groupBy("key").agg(F.max("value").alias("value"))
    return ingest.upsert(old, new, "key")


_REPLAY_TTL = 6 * 3600


@query(f"""WITH r AS (SELECT *, CASE WHEN event_type IN ('signup', 'purchase') THEN 'save' WHEN event_type = 'error' THEN 'delete' ELSE 'get' END AS op FROM events),
l AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN {{'op': op, 'at': ts, 'id': event_id}} END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM r),
a AS (SELECT *, coalesce(last.op = 'save' AND last.at >= ts - INTERVAL {_REPLAY_TTL} SECONDS, false) AS live FROM l)
SELECT event_id, user_id AS session_id, op, CASE WHEN op = 'save' THEN 'saved' WHEN NOT live THEN 'missing' WHEN op = 'delete' THEN 'deleted' ELSE 'loaded' END AS outcome,
CASE WHEN op = 'save' THEN CAST(event_id AS VARCHAR) WHEN live AND op = 'get' THEN CAST(last.id AS VARCHAR) END AS data FROM a""")
def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups and purchases save a user's session, errors delete it, all else asks for it."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "purchase"), "save").when(kind == "error", "delete").otherwise("get")
    requests = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts", op.alias("op"), F.col("user_id").cast("string").alias("user_id"), F.col("event_id").cast("string").alias("data")
    )
    found = sessions.replayed(requests, _REPLAY_TTL)
    return found.select(F.col("seq").alias("event_id"), "session_id", "op", "outcome", "data")


@query("""WITH c AS (
  SELECT conv_id AS thread, turn, 0 AS k, turn AS message, 'put' AS op, role, text FROM conversations
  UNION ALL SELECT conv_id, turn, 1, turn - 1, 'put', role, 'edited: ' || text FROM conversations WHERE turn % 3 = 2
  UNION ALL SELECT conv_id, turn, 2, turn - 2, 'remove', NULL, NULL FROM conversations WHERE turn % 5 = 4
), v AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY turn, k) AS version FROM c),
w AS (SELECT thread, max(version) AS "at" FROM v GROUP BY thread UNION SELECT thread, max(version) // 2 FROM v GROUP BY thread),
l AS (SELECT thread, "at", message, arg_max({'op': op, 'role': role, 'text': text}, version) AS last FROM v JOIN w USING (thread) WHERE version <= "at" GROUP BY thread, "at", message)
SELECT thread, "at", message, last.role AS role, last.text AS text FROM l WHERE last.op = 'put'""")
def conversation_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as it was half-way and as it is; some turns edit the one before them or take one back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), "turn", "role", "text")
    change = lambda k, back, op, text, role="role": F.struct(F.lit(k).alias("k"), (F.col("turn") - back).alias("message"), F.lit(op).alias("op"), F.expr(role).alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    changes = F.array(
        change(0, 0, "put", F.col("text")),
        F.when(F.col("turn") % 3 == 2, change(1, 1, "put", F.concat(F.lit("edited: "), "text"))),
        F.when(F.col("turn") % 5 == 4, change(2, 2, "remove", none, "CAST(NULL AS STRING)")),
    )
    flat = rows.select("thread", "turn", F.explode(changes).alias("c")).where("c IS NOT NULL").select("thread", "turn", "c.*")
    no_one = flat.select("thread", F.lit(0).cast("long").alias("last")).limit(0)
    numbered = versions.numbered(flat, no_one, ["turn", "k"])
    last = numbered.groupBy("thread").agg(F.max("version").alias("n"))
    wanted = last.select("thread", F.explode(F.array("n", F.floor(F.col("n") / 2))).alias("at"))
    # snapshots at each eighth version stand in for most changes
    nothing = spark.createDataFrame([], "thread long, version long")
    marks = last.select("thread", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(8).cast("long"))).alias("version")).where("version > 0")
    snapshots = versions.state_at(numbered, spark.createDataFrame([], versions.SNAPSHOTS), nothing, marks.withColumnRenamed("version", "at"))
    return versions.state_at(numbered, snapshots, marks, wanted)
