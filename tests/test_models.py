"""Learned embeddings against a dense decomposition and letters, the ranker against shared words, versions by replay."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvane.functions.models import letter_embedding
from korvane.operators import embedding_model, ingest, ranking, versions
from korvane.plans import learned, registry


def topic_rows(n, seed):
    rng = random.Random(seed)
    topics = [[f"w{t}x{k}" for k in range(25)] for t in range(4)]
    common = [f"the{k}" for k in range(10)]
    return [(i, " ".join(rng.choices(topics[i % 4], k=12) + rng.choices(common, k=12)), i % 4) for i in range(n)]


def test_embeddings_are_singular_vectors(spark, tmp_path):
    rows = topic_rows(160, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, topic int").repartition(3)
    model = embedding_model.fit(df, dimension=4, buckets=256, rounds=40, work_dir=str(tmp_path / "w"))
    words = [r.w for r in df.orderBy("doc_id").select(embedding_model.bucketed(F.col("text"), 256).alias("w")).collect()]
    a = np.zeros((len(rows), 256))
    for i, ws in enumerate(words):
        for w in ws:
            a[i, w] += 1
    a = np.log1p(a) * model.rarity
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    values, vectors = np.linalg.svd(a)[1:]
    assert np.allclose(np.abs(np.sum(model.axes * vectors[:4].T, axis=0)), 1, atol=1e-3), values[:6]
    got = np.array([r.e for r in df.orderBy("doc_id").select(model(F.col("text")).alias("e")).collect()])
    want = a @ model.axes
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-6)


def test_a_model_is_stored_and_made_again(spark, tmp_path):
    df = spark.createDataFrame(topic_rows(80, 2), "doc_id long, text string, topic int")
    model = embedding_model.fit(df, dimension=5, buckets=128)
    model.write(spark, str(tmp_path / "m"))
    back = embedding_model.read(spark, str(tmp_path / "m"))
    again = embedding_model.fit(df.repartition(5), dimension=5, buckets=128)
    assert np.array_equal(back.axes, model.axes) and np.allclose(again.axes, model.axes, atol=1e-8)
    with pytest.raises(FileNotFoundError):
        embedding_model.read(spark, str(tmp_path / "none"))


def test_awkward_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "x " * 50_000)], "id long, text string")
    model = embedding_model.fit(df, dimension=3, buckets=64)
    got = {r.id: r.e for r in df.select("id", model(F.col("text")).alias("e")).collect()}
    assert got[1] == got[2] == got[3] == [0.0] * 3 and np.isclose(np.linalg.norm(got[5]), 1)
    empty = embedding_model.fit(df.limit(0), dimension=3, buckets=64)
    assert empty.axes.shape == (64, 3) and not empty.axes.any()


def share_of_neighbours(vectors, labels, k=5):
    x = np.array(vectors, float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    near = np.argsort(-s, axis=1)[:, :k]
    return np.mean([[labels[i] == labels[j] for j in row] for i, row in enumerate(near)])


def test_neighbours_share_topics_more_often_than_by_letters(spark):
    df = spark.createDataFrame(topic_rows(200, 3), "doc_id long, text string, topic int")
    model = embedding_model.fit(df, dimension=8, buckets=512)
    rows = df.select("topic", model(F.col("text")).alias("e"), letter_embedding(F.col("text")).alias("l")).collect()
    topics = [r.topic for r in rows]
    assert share_of_neighbours([r.e for r in rows], topics) > share_of_neighbours([r.l for r in rows], topics) + 0.2


def test_neighbours_of_the_corpus_share_more_words_than_by_letters(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 200")
    model = embedding_model.fit(docs)
    rows = docs.select("lang", "text", model(F.col("text")).alias("e"), letter_embedding(F.col("text")).alias("l")).collect()
    words = [set(r.text.lower().split()) for r in rows]

    def shared(vectors, k=5):
        x = np.array(vectors, float)
        s = (x @ x.T) / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1), 1e-12)
        np.fill_diagonal(s, -2)
        return np.mean([[len(words[i] & words[j]) / len(words[i] | words[j]) for j in near] for i, near in enumerate(np.argsort(-s, axis=1)[:, :k])])

    assert share_of_neighbours([r.e for r in rows], [r.lang for r in rows]) > 0.9
    assert shared([r.e for r in rows]) > shared([r.l for r in rows])


def test_features(spark):
    df = spark.createDataFrame([("a b", "x A y b a"), ("a b", "z a b"), ("", "a"), ("a", None), ("a", "")], "q string, t string")
    got = [r.x for r in df.select(ranking.features(F.col("q"), F.col("t")).alias("x")).collect()]
    assert got[0][0] == 1.0 and got[0][2] == 0.5 and got[0][3] == 0.0 and got[0][4] == pytest.approx(0.8)
    assert got[1][3] == 1.0 and got[0][1] > got[1][1]
    assert got[2][:4] == [0.0] * 4 and got[3] == got[4] == [0.0] * 6


def test_newton_equals_gradient_descent(spark):
    rng = np.random.default_rng(0)
    rows = []
    for q in range(12):
        for i in range(9):
            x = rng.normal(size=6)
            rows.append((q, i, x.tolist(), int(x[0] - 0.5 * x[4] + rng.normal() > 0) + int(x[0] > 1)))
    df = spark.createDataFrame(rows, "query_id long, id long, x array<double>, grade int")
    ranker = ranking.fit(df)
    assert ranking.fit(df.repartition(5)) == ranker
    scale = 1 / np.std([r[2] for r in rows], axis=0)
    w = np.zeros(6)
    pairs = [(np.array(a[2]) - np.array(b[2])) * scale for a in rows for b in rows if a[0] == b[0] and a[3] > b[3]]
    d = np.array(pairs)
    for _ in range(20_000):
        w += 0.5 * ((1 / (1 + np.exp(d @ w))) @ d / len(d) - ranking.DECAY * w)
    assert np.allclose(np.array(ranker.weights) / scale, w, atol=1e-4)


def test_ndcg(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 0), (1, 2, 0.8, 1), (1, 3, 0.1, 2), (2, 1, 0.0, 0), (3, 1, 0.5, 1), (3, 2, 0.5, 0)], "query_id int, id int, score double, grade int")
    got = {r.query_id: r.ndcg for r in ranking.ndcg(df, 2).collect()}
    assert got[1] == pytest.approx((1 / np.log2(3)) / (3 + 1 / np.log2(3))) and got[2] == 0.0 and got[3] == 1.0


def test_ordered_pairs(spark):
    rng = random.Random(2)
    rows = [(q, i, rng.randrange(4) / 2, rng.randrange(3)) for q in range(6) for i in range(12)] + [(9, 1, 0.5, 1)]
    got = {r.query_id: r.share for r in ranking.ordered_pairs(spark.createDataFrame(rows, "query_id int, id int, score double, grade int")).collect()}
    for q in range(6):
        pairs = [(a[2] > b[2]) + 0.5 * (a[2] == b[2]) for a in rows for b in rows if a[0] == b[0] == q and a[3] > 0 and b[3] == 0]
        assert got[q] == pytest.approx(np.mean(pairs))
    assert got[9] is None


def test_the_ranker_beats_shared_words_on_held_out_items(spark, sf):
    rows = registry.QUERIES["ranker_quality"](spark, sf.replace("sf0.001", "sf0.01")).collect()
    assert len(rows) >= 3
    assert np.mean([r.learned_ndcg for r in rows]) > np.mean([r.shared_ndcg for r in rows])
    mean = lambda c: np.mean([r[c] for r in rows if r[c] is not None])
    assert mean("learned_pairs") > mean("shared_pairs") + 0.1
    pairs = learned.judged(spark, sf)
    train, test = (pairs.where(f"held_out = {x}") for x in ("false", "true"))
    assert train.join(test, "query_id", "left_semi").isEmpty() and train.join(test, "id", "left_semi").isEmpty()


# --- versions ---------------------------------------------------------------------------------------------------------


def replayed(changes, thread, at):
    state = {}
    for t, message, op, role, text in [c for c in changes if c[0] == thread][:at]:
        if op == "put":
            state[message] = (role, text)
        else:
            state.pop(message, None)
    return state


def test_any_version_equals_replaying_to_it(spark, tmp_path):
    rng = random.Random(8)
    changes = [(rng.randrange(3), rng.randrange(6), rng.choice(["put", "put", "remove"]), "user", f"t{i}") for i in range(120)]
    path, schema = str(tmp_path / "v"), "thread long, message long, op string, role string, text string, i long"
    wanted = spark.createDataFrame([(t, v) for t in range(3) for v in range(0, 60, 3)], "thread long, at long")
    snapshots = 0
    for a in range(0, 120, 30):
        versions.append_changes(spark.createDataFrame([(*c, i) for i, c in enumerate(changes[a : a + 30])], schema).repartition(3), path, ["i"])
        snapshots += versions.write_snapshots(spark, path, 8)
        got = {}
        for r in versions.restore(spark, path, wanted).collect():
            got.setdefault((r.thread, r["at"]), {})[r.message] = (r.role, r.text)
        seen = changes[: a + 30]
        assert got == {(t, v): s for t in range(3) for v in range(0, 60, 3) if (s := replayed(seen, t, v))}
    assert snapshots > 3 and versions.write_snapshots(spark, path, 8) == 0
    plan = versions.restore(spark, path, wanted)
    assert plan.columns == ["thread", "at", "message", "role", "text"]


def test_a_snapshot_without_its_mark_does_not_count(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = [(1, m, "put", "user", f"t{m}", m) for m in range(10)]
    versions.append_changes(spark.createDataFrame(rows, "thread long, message long, op string, role string, text string, i long"), path, ["i"])
    spark.createDataFrame([(1, 8, 0, "user", "wrong")], versions.SNAPSHOTS).write.parquet(f"{path}/snapshots")  # of a writer that died
    found = versions.restore(spark, path, spark.createDataFrame([(1, 9)], "thread long, at long")).collect()
    assert {r.message: r.text for r in found} == {m: f"t{m}" for m in range(9)}


# --- footers ----------------------------------------------------------------------------------------------------------

META = {"embedding_model": "m", "embedding_dimension": "2", "provider_type": "p", "total_chunks": "6", "generated_at": "now"}


def test_footers_of_all_files(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = spark.createDataFrame([(str(i), [1.0, float(i)]) for i in range(6)], "chunk_id string, embedding array<float>").repartition(3)
    ingest.write_embeddings(rows, path, META)
    found = ingest.footers(spark, f"{path}/data")
    assert found.count() == 3 and ingest.disagreeing(found).isEmpty()
    assert {tuple(r[k] for k in META) for r in found.collect()} == {tuple(META.values())}
    table, meta = ingest.read_embeddings(spark, path, 2)
    assert meta == META and table.count() == 6
    other = rows.withMetadata("chunk_id", {"embeddings": META | {"embedding_model": "other"}}).coalesce(1)
    other.write.mode("append").parquet(f"{path}/data")
    rows.coalesce(1).write.mode("append").parquet(f"{path}/data")
    odd = ingest.disagreeing(ingest.footers(spark, f"{path}/data")).collect()
    assert sorted(str(r.embedding_model) for r in odd) == ["None", "other"]


def test_a_missing_key_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<float>")
    rows.withMetadata("chunk_id", {"embeddings": {"embedding_model": "m"}}).write.parquet(str(tmp_path / "data"))
    with pytest.raises(ValueError, match="embedding_dimension, provider_type, total_chunks"):
        ingest.read_embeddings(spark, str(tmp_path))
