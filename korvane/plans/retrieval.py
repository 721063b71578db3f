"""Vector, keyword and hybrid search over ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions.models import LETTERS, tokens_of
from korvane.operators import lexical, search, vector, vector_index
from korvane.plans.base import CHUNKS, WORDS, embedded_chunks, query, stored, table

K = 10
TEXT = "the le die blees worthless"
VARIATIONS = ("the le die", "blees and threein", "worthless", "heure und nicht")
ALPHA = 0.5


def embedded(text: str) -> str:
    """The letter counts of a query as an SQL literal."""
    return "[" + ", ".join(f"{text.lower().count(c)}.0" for c in LETTERS) + "]::DOUBLE[]"


_LETTERS = ", ".join(f"(length(lower(chunk_text)) - length(replace(lower(chunk_text), '{c}', '')))::DOUBLE" for c in LETTERS)
VECTORS = f"{CHUNKS}, v AS (SELECT *, [{_LETTERS}] AS e FROM chunks)"
_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(set(TEXT.split()))) + "]"
_OVERLAP = rf"round(len(list_intersect({_LIST}, regexp_split_to_array(lower(chunk_text), '\s+'))) / {len(set(TEXT.split()))}.0::DOUBLE, 6)"
COSINE = "CASE WHEN list_sum(list_transform({a}, lambda x: x * x)) > 0 THEN round(list_cosine_similarity({a}, {b}), 6) END"
_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _first_vector(rows: DataFrame) -> list[float]:
    return list(rows.where("vec_id = 0").first()["embedding"])


@query(f"""WITH {_Q} SELECT vec_id, label, {COSINE.format(a="embedding::DOUBLE[]", b="q")} AS similarity_score FROM embeddings, q
ORDER BY similarity_score DESC NULLS LAST, vec_id LIMIT {K}""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vector.top_k(rows, _first_vector(rows), K, "vec_id")


@query(f"""WITH {_Q} SELECT vec_id, label, {COSINE.format(a="embedding::DOUBLE[]", b="q")} AS similarity_score FROM embeddings, q
WHERE label = 3 ORDER BY similarity_score DESC NULLS LAST, vec_id LIMIT {K}""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two filters the unknown one is dropped."""
    rows = table(spark, sf_dir, "embeddings")
    found = vector.metadata_filter(rows, {"label": 3, "colour": "red"}, allowed=("label",))
    return vector.top_k(found, _first_vector(rows), K, "vec_id")


@query(f"""WITH {_Q} SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance
FROM embeddings, q ORDER BY distance, vec_id LIMIT {K}""")
def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vector.top_k(rows, _first_vector(rows), K, "vec_id", metric="l2", score_col="distance")


@query(f"""WITH {_Q} SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], q), 6) AS similarity_score
FROM embeddings, q ORDER BY similarity_score DESC NULLS LAST, vec_id LIMIT {K}""")
def vector_topk_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vector.top_k(rows, _first_vector(rows), K, "vec_id", metric="inner")


@query(f"""WITH {_Q}, h AS (
  SELECT vec_id, label, {COSINE.format(a="embedding::DOUBLE[]", b="q")} AS similarity_score,
         CAST(len(list_filter(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] > 0) <> (p[2] > 0))) AS BIGINT) AS hamming
  FROM embeddings, q
), near AS (SELECT * FROM h ORDER BY hamming, vec_id LIMIT 100)
SELECT vec_id, label, hamming, similarity_score FROM near ORDER BY similarity_score DESC NULLS LAST, vec_id LIMIT {K}""")
def hamming_topk_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the stored signs of all rows; their vectors are read only then."""
    first = _first_vector(table(spark, sf_dir, "embeddings"))
    near = _vector_index(spark, sf_dir).candidates(first, 100, None)
    near = near.withColumn("hamming", vector.hamming(vector.sign_words(F.col("vector"), len(first)), vector.signs_of(first)))
    return vector.top_k(near, first, K, "id", "vector").select(F.col("id").alias("vec_id"), "label", "hamming", "similarity_score")


@query(f"""WITH {_Q} SELECT vec_id, label, {COSINE.format(a="embedding::DOUBLE[]", b="q")} AS similarity_score FROM embeddings, q
ORDER BY similarity_score DESC NULLS LAST, vec_id LIMIT {K}""")
def half_topk_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the stored 16-bit floats, ordered again by exact cosine."""
    found = _vector_index(spark, sf_dir).top_k(_first_vector(table(spark, sf_dir, "embeddings")), K, None, code="half")
    return found.select(F.col("id").alias("vec_id"), "label", "similarity_score")


def _vector_index(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    """The stored index of ``embeddings``, made by the first search."""
    return vector_index.read(spark, stored(spark, sf_dir, "embeddings", "vectors", "about/_SUCCESS", vector_index.build))


def _each(spark: SparkSession, sf_dir: str, probes: int | None) -> DataFrame:
    """The neighbours of every row whose id is divisible by 50."""
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = _vector_index(spark, sf_dir).top_k_each(queries, K, probes)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), "similarity_score")


@query()
def vector_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the lists that each query probes: at least 0.9 of the exact neighbours, which a test measures."""
    return _each(spark, sf_dir, 0)


@query(f"""WITH s AS (
  SELECT a.vec_id AS query_id, b.vec_id, {COSINE.format(a="b.embedding::DOUBLE[]", b="a.embedding::DOUBLE[]")} AS similarity_score
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0
) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC NULLS LAST, vec_id) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC NULLS LAST, vec_id) <= {K}""")
def vector_topk_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all lists, which is exact."""
    return _each(spark, sf_dir, None)


@query(f"WITH {_Q} SELECT vec_id, {COSINE.format(a='embedding::DOUBLE[]', b='q')} AS similarity FROM embeddings, q")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    q = F.lit([float(x) for x in _first_vector(rows)]).cast("array<double>")
    return rows.select("vec_id", F.round(vector.cosine(F.col("embedding"), q), vector.DIGITS).alias("similarity"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, CAST(len(embedding) AS BIGINT) AS dims FROM embeddings")
def vector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as text and read again."""
    rows = table(spark, sf_dir, "embeddings").withColumn("v", vector.parse_vector(F.to_json(F.col("embedding").cast("array<double>"))))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), vector.DIGITS).alias("total"), F.size("v").cast("long").alias("dims"))


_SHOWN = "chunk_id, source_document, chapter_title, token_count, similarity_score"
_SHOWN_COLUMNS = _SHOWN.split(", ")


@query(f"""WITH {VECTORS} SELECT chunk_id, source_document, chapter_title, token_count, {COSINE.format(a="e", b=embedded(TEXT))} AS similarity_score
FROM v WHERE source_document = 'src1' OR chapter_title = 'en' ORDER BY similarity_score DESC NULLS LAST, chunk_id LIMIT {K}""")
def search_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters are joined by OR."""
    found = search.search("simple", embedded_chunks(spark, sf_dir), TEXT, K, filters={"source_document": "src1", "chapter_title": "en"})
    return found.select(*_SHOWN_COLUMNS)


@query(f"""WITH {VECTORS}, near AS (
  SELECT *, {COSINE.format(a="e", b=embedded(TEXT))} AS similarity_score FROM v ORDER BY similarity_score DESC NULLS LAST, chunk_id LIMIT {4 * K}
)
SELECT {_SHOWN}, {_OVERLAP} AS rerank_score FROM near ORDER BY rerank_score DESC, similarity_score DESC NULLS LAST, chunk_id LIMIT {K}""")
def search_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search("rerank", embedded_chunks(spark, sf_dir), TEXT, K).select(*_SHOWN_COLUMNS, "rerank_score")


_EACH = " UNION ALL ".join(f"SELECT {i} AS variation, {embedded(t)} AS q" for i, t in enumerate(VARIATIONS))


@query(f"""WITH {VECTORS}, qs AS ({_EACH}), scored AS (
  SELECT v.*, variation, {COSINE.format(a="e", b="q")} AS similarity_score FROM v, qs
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY variation ORDER BY similarity_score DESC NULLS LAST, chunk_id) - 1 AS rank FROM scored
), once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY variation, rank) AS i FROM ranked WHERE rank < {K}) WHERE i = 1
)
SELECT {_SHOWN}, {_OVERLAP} AS rerank_score FROM once ORDER BY rerank_score DESC, variation, rank, chunk_id LIMIT {K}""")
def search_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search("advanced", embedded_chunks(spark, sf_dir), TEXT, K, VARIATIONS).select(*_SHOWN_COLUMNS, "rerank_score")


@query(f"""WITH {VECTORS}, qs AS ({_EACH}), scored AS (
  SELECT chunk_id, variation, {COSINE.format(a="e", b="q")} AS similarity_score FROM v, qs
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY variation ORDER BY similarity_score DESC NULLS LAST, chunk_id) - 1 AS BIGINT) AS rank FROM scored
)
SELECT chunk_id, CAST(variation AS BIGINT) AS variation, rank, similarity_score
FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY variation, rank) AS i FROM ranked WHERE rank < {K}) WHERE i = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded_chunks(spark, sf_dir)
    found = vector.dedup_first(vector.top_k_each(rows, search.embed_queries(spark, VARIATIONS), K))
    return found.select("chunk_id", F.col("variation").cast("long").alias("variation"), F.col("rank").cast("long").alias("rank"), "similarity_score")


REQUEST = 50


@query(f"""WITH {CHUNKS}, r AS (SELECT *, chunk_id // {REQUEST} AS request, row_number() OVER (PARTITION BY chunk_id // {REQUEST} ORDER BY chunk_id) - 1 AS i FROM chunks)
SELECT CAST(request AS BIGINT) AS request, CAST(i AS BIGINT) AS index, {_OVERLAP} AS score FROM r""")
def rerank_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, in requests of the texts of fifty neighbouring ids each."""
    rows = embedded_chunks(spark, sf_dir).select(F.floor(F.col("chunk_id") / REQUEST).alias("request"), "chunk_id", "chunk_text")
    requests = rows.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "chunk_text"))), lambda x: x["chunk_text"]).alias("texts"))
    return search.rerank_indexed(requests, TEXT).select(F.col("request").cast("long").alias("request"), F.col("index").cast("long").alias("index"), "score")


@query(f"""WITH {VECTORS}, near AS (
  SELECT *, {COSINE.format(a="e", b=embedded(TEXT))} AS similarity_score FROM v ORDER BY similarity_score DESC NULLS LAST, chunk_id LIMIT {K}
) SELECT {_SHOWN}, NULL::DOUBLE AS rerank_score FROM near""")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a scorer the order of the candidates stays."""
    found = search.search_simple(embedded_chunks(spark, sf_dir), TEXT, 4 * K)
    return search.rerank_or_keep(found, TEXT, K, None).select(*_SHOWN_COLUMNS, "rerank_score")


@query(f"WITH {WORDS} SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM words")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", tokens_of(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


BM25 = f"""{WORDS.replace("words AS (", "words AS MATERIALIZED (")}, dl AS (SELECT id, len(w) AS dl FROM words), stats AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM words) GROUP BY id, term),
counted AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
df AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM counted, stats), mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM df),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {lexical.EPSILON} * mean ELSE raw END AS idf FROM df, mean),
hit AS (SELECT id, sum(idf * tf * {lexical.K1 + 1} / (tf + {lexical.K1} * ({1 - lexical.B} + {lexical.B} * dl / avgdl))) AS s
        FROM tf JOIN idf USING (term) JOIN dl USING (id), stats WHERE term IN ({", ".join(f"'{w}'" for w in TEXT.split())}) GROUP BY id),
bm25 AS MATERIALIZED (SELECT dl.id, round(coalesce(s, 0), 6) AS bm25 FROM dl LEFT JOIN hit USING (id))"""


def _index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The stored index of ``documents``, made by the first search."""
    return lexical.read_index(spark, stored(spark, sf_dir, "documents", "bm25", "stats/_SUCCESS", lexical.add_documents))


@query(f"""WITH {WORDS}, counted AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM words) GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM counted)
SELECT term, df, round(CASE WHEN raw < 0 THEN {lexical.EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END, 6) AS idf FROM raw""")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).frequencies().select("term", "df", F.round("idf", lexical.DIGITS).alias("idf"))


@query(f"WITH {BM25} SELECT id, bm25 FROM bm25")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).scores(TEXT)


_SCALED = "CASE WHEN (SELECT max({c}) = min({c}) FROM {t}) THEN 0.5 ELSE ({c} - (SELECT min({c}) FROM {t})) / (SELECT max({c}) - min({c}) FROM {t}) END"


@query(f"WITH {BM25} SELECT id, round({_SCALED.format(c='bm25', t='bm25')}, 6) AS scaled FROM bm25")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = lexical.min_max(_index(spark, sf_dir).scores(TEXT), "bm25", "scaled")
    return scaled.select("id", F.round("scaled", lexical.DIGITS).alias("scaled"))


@query(f"WITH {BM25} SELECT min(bm25) AS lowest, max(bm25) AS highest, round(avg(bm25), 6) AS mean, count(*) AS n FROM bm25")
def score_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).scores(TEXT).agg(
        F.min("bm25").alias("lowest"), F.max("bm25").alias("highest"), F.round(F.avg("bm25"), lexical.DIGITS).alias("mean"), F.count("*").alias("n")
    )


@query(f"WITH {BM25} SELECT n AS n_documents, round(avgdl, 6) AS mean_words, (SELECT count(*) FROM df) AS n_terms, {ALPHA}::DOUBLE AS alpha FROM stats")
def hybrid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.hybrid_stats(_index(spark, sf_dir), ALPHA)


_FUSED = f"""{BM25}, {VECTORS}, near AS (
  SELECT chunk_id AS id, {COSINE.format(a="e", b=embedded(TEXT))} AS sim FROM v ORDER BY sim DESC NULLS LAST, chunk_id LIMIT {3 * K}
), vec AS (SELECT id, 1.0::DOUBLE / row_number() OVER (ORDER BY sim DESC NULLS LAST, id) AS vec FROM near),
a AS (SELECT id, {_SCALED.format(c="vec", t="vec")} AS v FROM vec), b AS (SELECT id, {_SCALED.format(c="bm25", t="bm25")} AS k FROM bm25),
fused AS (SELECT id, round({ALPHA} * coalesce(a.v, 0) + {1 - ALPHA} * coalesce(b.k, 0), 6) AS score FROM a FULL JOIN b USING (id))"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.search_simple(embedded_chunks(spark, sf_dir), TEXT, 3 * K)
    ranks = lexical.reciprocal_ranks(near, "similarity_score", "chunk_id")
    return lexical.fuse(ranks, _index(spark, sf_dir).scores(TEXT), ALPHA)


@query(f"WITH {_FUSED} SELECT id, score FROM fused ORDER BY score DESC, id LIMIT {K}")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).orderBy(F.desc("score"), "id").limit(K)


@query(f"""WITH {_FUSED}, child AS (
  SELECT CAST(f.id AS VARCHAR) AS id, source AS parent_id, score, source <> 'src1' AS known FROM fused f JOIN documents d ON f.id = d.doc_id
), once AS (
  SELECT *, row_number() OVER (PARTITION BY CASE WHEN known THEN 'p:' || parent_id ELSE 'c:' || id END ORDER BY score DESC, id) AS i FROM child
)
SELECT CASE WHEN known THEN parent_id ELSE id END AS id, id AS via, score FROM once WHERE i = 1 ORDER BY score DESC, via LIMIT {K}""")
def hybrid_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are the children of their source; one source is missing, so its documents stay themselves."""
    docs = table(spark, sf_dir, "documents")
    parents = docs.select(F.col("source").alias("id")).where("id <> 'src1'").distinct()
    scored = _fused(spark, sf_dir).join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("parent_id")), "id")
    return lexical.lift_parents(scored.withColumn("id", F.col("id").cast("string")), parents, K)
