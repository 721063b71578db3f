"""Every registered query runs, and gives what its SQL gives."""

from __future__ import annotations

import pytest
from oracle import of_frame, of_sql, tables

import __spark_entry__ as entry
from korvane.plans import base, learned, registry


def test_entry_is_a_top_k(spark):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "label", "similarity_score"]
    assert df.count() == 10


def test_names():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert of_frame(df) == of_sql(tables(sf), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_a_top_k_of_each_partition(spark, sf):
    plan = plan_of(registry.QUERIES["vector_topk"](spark, sf))
    assert "TakeOrderedAndProject" in plan
    assert "Exchange rangepartitioning" not in plan


def test_filter_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(registry.QUERIES["vector_topk_filtered"](spark, sf))
    assert "EqualTo(label,3)" in plan
    plan = plan_of(registry.QUERIES["document_tokens"](spark, sf))
    assert "doc_id" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("name", ["split_recursive", "parent_child_chunks", "search_learned"])
def test_python_gets_few_texts_at_a_time(spark, sf, name, monkeypatch, tmp_path):
    """What a worker holds doesn't grow with the rows of its partition."""

    def made_anew(spark, sf_dir, table, tag, ready, make):
        make(base.table(spark, sf_dir, table), str(tmp_path / tag))
        return str(tmp_path / tag)

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(learned, "stored", made_anew)
    spark.conf.set(key, 10_000)
    registry.QUERIES[name](spark, sf)
    assert int(spark.conf.get(key)) <= 500
