"""The stored index of vectors against exact search, and what it reads."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvane.operators import vector, vector_index
from korvane.plans import registry
from korvane.session import exists


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def clustered(n, d, seed, centres=20):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d))
    return [(int(i), [float(np.float32(x)) for x in middle[i % centres] + 0.4 * rng.normal(size=d)], f"c{i % centres}") for i in range(n)]


ODD = [(9001, None, "n"), (9002, [0.0] * 12, "z"), (9003, [1.0], "short"), (9004, [float("nan")] * 12, "nan"), (9005, [None] * 12, "null")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = clustered(1500, 12, 1)
    path = str(tmp_path_factory.mktemp("index") / "i")
    df = spark.createDataFrame(rows + ODD, "vec_id long, embedding array<float>, label string").repartition(3)
    vector_index.build(df, path, lists=24)
    return rows, path


def cosine(a, b):
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)


def exact(rows, query, k):
    return [i for _, i in sorted((-cosine(v, query), i) for i, v, _ in rows)[:k]]


def test_all_lists_are_exact(spark, made):
    rows, path = made
    index = vector_index.read(spark, path)
    assert index.n == 1500 + 1 and index.dimension == 12  # the short one counts but is in no list
    queries = spark.createDataFrame([(r[0], r[1]) for r in rows[::50]], "query_id long, vector array<float>")
    found = {}
    for r in index.top_k_each(queries, 10, None).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    assert found == {r[0]: exact(rows, r[1], 10) for r in rows[::50]}


def test_recall_of_probed_lists(spark, made):
    rows, path = made
    index = vector_index.read(spark, path)
    assert index.probes < len(index.centroids)
    queries = spark.createDataFrame([(r[0], r[1]) for r in rows[::50]], "query_id long, vector array<float>")
    found = {(r.query_id, r.id) for r in index.top_k_each(queries, 10).collect()}
    want = {(r[0], i) for r in rows[::50] for i in exact(rows, r[1], 10)}
    assert len(found & want) / len(want) >= 0.9


def test_keys_of_few_rows_give_the_same(spark, made, monkeypatch):
    rows, path = made
    monkeypatch.setattr(vector_index, "KEY_ROWS", 20)
    monkeypatch.setattr(vector_index, "KEY_QUERIES", 3)
    index = vector_index.read(spark, path)
    queries = spark.createDataFrame([(r[0], r[1]) for r in rows[:40]] + [(-1, None), (-2, [0.0] * 12)], "query_id long, vector array<float>")
    found = {}
    for r in index.top_k_each(queries, 4, None).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    assert found == {r[0]: exact(rows, r[1], 4) for r in rows[:40]}


@pytest.mark.parametrize("code", ["signs", "half"])
def test_candidates_by_codes(spark, made, code):
    rows, path = made
    index = vector_index.read(spark, path)
    query = rows[7][1]
    near = {r.id for r in index.candidates(query, 60, None, code).collect()}
    if code == "half":
        want = sorted(rows, key=lambda r: (-np.dot(h := np.float64(np.float16(r[1])), query) / np.linalg.norm(h) / np.linalg.norm(query), r[0]))
        assert near == {r[0] for r in want[:60]}
    else:
        assert near == {i for _, i in sorted((sum((a > 0) != (b > 0) for a, b in zip(v, query, strict=True)), i) for i, v, _ in rows)[:60]}
    found = [r.id for r in index.top_k(query, 5, None, 60, code).collect()]
    assert found == [i for i in exact(rows, query, 1500) if i in near][:5]


def test_search_reads_probed_folders_and_codes_first(spark, made):
    rows, path = made
    index = vector_index.read(spark, path)
    plan = plan_of(index.top_k(rows[0][1], 5, 2))
    assert plan.count("PartitionFilters: [isnotnull(list") + plan.count("PartitionFilters: [list") + plan.count("PartitionFilters: [dynamicpruning") >= 2
    codes = next(x for x in plan.split("FileScan") if "/codes" in x)
    assert "signs" in codes.split("ReadSchema")[1] and "vector" not in codes.split("ReadSchema")[1] and "half" not in codes.split("ReadSchema")[1]


def test_an_unfinished_index_is_none(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        vector_index.read(spark, str(tmp_path / "no"))
    df = spark.createDataFrame(clustered(30, 4, 2, 3), "vec_id long, embedding array<float>, label string")
    path = str(tmp_path / "i")
    df.select("vec_id").write.parquet(f"{path}/vectors")  # what a build that died left
    vector_index.build(df, path)
    assert vector_index.read(spark, path).n == 30
    with pytest.raises(FileExistsError):
        vector_index.build(df, path)
    with pytest.raises(ValueError):
        vector_index.read(spark, path).candidates([1.0], 5)


def test_one_vector_many_times(spark, tmp_path):
    """A third of all rows are one vector; ties go to smaller ids."""
    rng = random.Random(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    path = str(tmp_path / "i")
    vector_index.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), path, lists=8)
    index = vector_index.read(spark, path)
    queries = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "query_id long, vector array<float>")
    assert [r.id for r in index.top_k_each(queries, 7, None).orderBy("rank").collect()] == [0, 3, 6, 9, 12, 15, 18]
    assert [r.id for r in index.top_k([1.0, 2.0, 3.0], 3).collect()] == [0, 3, 6]


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "i")
    vector_index.build(spark.createDataFrame(ODD[:2] + ODD[3:], "vec_id long, embedding array<float>, label string"), path)
    index = vector_index.read(spark, path)
    assert index.n == 0
    queries = spark.createDataFrame([(0, [1.0] * 12)], "query_id long, vector array<float>")
    assert index.top_k_each(queries, 3).count() == 0


def test_centroids_are_the_same_again(spark, made, tmp_path):
    rows, path = made
    df = spark.createDataFrame(rows + ODD, "vec_id long, embedding array<float>, label string")
    vector_index.build(df, str(tmp_path / "i"), lists=24)
    again = vector_index.read(spark, str(tmp_path / "i"))
    assert np.allclose(again.centroids, vector_index.read(spark, path).centroids, atol=1e-9)


def test_query_of_the_index_finds_nine_in_ten(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    exact_rows = {(r.query_id, r.vec_id) for r in registry.QUERIES["vector_topk_all_lists"](spark, sf).collect()}
    found = {(r.query_id, r.vec_id) for r in registry.QUERIES["vector_topk_indexed"](spark, sf).collect()}
    assert len(exact_rows) >= 400 and len(found & exact_rows) / len(exact_rows) >= 0.9


def test_signs_of_a_query_are_those_of_a_vector(spark):
    v = [0.5, -1.0, 0.0] * 25
    row = spark.createDataFrame([(v,)], "v array<double>").select(vector.sign_words(F.col("v"), 75).alias("a"), vector.signs_of(v).alias("b")).first()
    assert row.a == row.b and not exists(spark, "/nowhere/at/all")
