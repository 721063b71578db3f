"""Changes of the stored keyword index: each state equals an index made anew."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from korvane.operators import lexical

WORDS = ["a", "b", "c", "dd", "ee", "f", "gg"]


def texts(ids, seed):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices(WORDS, k=rng.randrange(12))) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def state(spark, path, query="a dd dd zz"):
    index = lexical.read_index(spark, path)
    frequencies = {r.term: (r.df, round(r.idf, 9)) for r in index.frequencies().collect()}
    return index.n, index.words, index.n_terms, round(index.mean_idf or 0, 9), frequencies, {r.id: r.bm25 for r in index.scores(query).collect()}


def fresh(spark, docs, path):
    lexical.add_documents(frame(spark, docs), path)
    return state(spark, path)


def test_deletions_replacements_and_merges_equal_a_fresh_index(spark, tmp_path):
    path, docs = str(tmp_path / "i"), texts(range(30), 1)
    lexical.add_documents(frame(spark, docs), path)
    more = texts(range(30, 45), 2)
    lexical.add_documents(frame(spark, more), path)
    docs |= more

    gone = [3, 4, 31, 777]
    lexical.delete_documents(spark.createDataFrame([(i,) for i in gone + gone], "id long"), path)
    docs = {i: t for i, t in docs.items() if i not in gone}
    assert state(spark, path) == fresh(spark, docs, str(tmp_path / "f1"))

    new = texts([5, 40, 50], 3) | {6: "only here"}
    with pytest.raises(ValueError, match="has these ids"):
        lexical.add_documents(frame(spark, new), path)
    assert state(spark, path)[0] == len(docs)
    lexical.add_documents(frame(spark, new), path, replace=True)
    docs |= new
    want = fresh(spark, docs, str(tmp_path / "f2"))
    assert state(spark, path) == want

    lexical.merge_generations(spark, path)
    assert state(spark, path) == want
    assert lexical.drop_unused(spark, path) and not lexical.drop_unused(spark, path)
    assert state(spark, path) == want
    lexical.delete_documents(spark.createDataFrame([(5,)], "id long"), path)
    lexical.add_documents(frame(spark, {3: "a back again"}), path)  # a deleted id may come back
    docs = {i: t for i, t in docs.items() if i != 5} | {3: "a back again"}
    assert state(spark, path) == fresh(spark, docs, str(tmp_path / "f3"))


def test_repeated_ids_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="twice"):
        lexical.add_documents(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string"), str(tmp_path / "i"))


def test_a_broken_change_changes_nothing(spark, tmp_path, monkeypatch):
    path, docs = str(tmp_path / "i"), texts(range(8), 4)
    (tmp_path / "i" / "stats" / "_temporary").mkdir(parents=True)  # what a writer that died leaves
    with pytest.raises(FileNotFoundError):
        lexical.read_index(spark, path)
    want = fresh(spark, docs, path)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(lexical, "_commit", dies)
        for change in (lambda: lexical.add_documents(frame(spark, texts([3, 90], 5)), path, replace=True), lambda: lexical.delete_documents(spark.createDataFrame([(3,)], "id long"), path), lambda: lexical.merge_generations(spark, path)):
            with pytest.raises(RuntimeError, match="lost"):
                change()
    assert state(spark, path) == want
    assert lexical.drop_unused(spark, path)
    assert state(spark, path) == want


def test_deleting_everything(spark, tmp_path):
    path, docs = str(tmp_path / "i"), texts(range(3), 6)
    lexical.add_documents(frame(spark, docs), path)
    lexical.delete_documents(spark.createDataFrame([(i,) for i in docs], "id long"), path)
    assert state(spark, path) == (0, 0, 0, 0, {}, {})
    lexical.merge_generations(spark, path)
    assert state(spark, path)[0] == 0
    lexical.add_documents(frame(spark, docs), path)
    assert state(spark, path)[0] == 3


def test_words_are_counted_in_their_rows_and_files_stay_small(spark, tmp_path, monkeypatch):
    """No word is shuffled before it is counted; one folder's postings are dealt over files by the number of words, not of documents."""
    docs = spark.createDataFrame([(i, " ".join(f"W{(i * j) % 97}" for j in range(i))) for i in range(60)] + [(60, None), (61, " \n")], "doc_id long, text string")
    posted = lexical.postings(docs)
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
    want = Counter((r.doc_id, w) for r in docs.collect() for w in (r.text or "").lower().split())
    assert {(r.id, r.term): r.tf for r in posted.collect()} == want
    assert all(r.dl == r.id for r in posted.collect())
    monkeypatch.setattr(lexical, "FILE_WORDS", 10)
    lexical.add_documents(docs, str(tmp_path / "many"))
    monkeypatch.undo()
    lexical.add_documents(docs, str(tmp_path / "one"))
    many, one = (lexical.read_index(spark, str(tmp_path / x)) for x in ("many", "one"))
    files = Counter(p.parent.name for p in (tmp_path / "many" / "postings").rglob("*.parquet"))
    assert len(files) == lexical.FOLDERS and min(files.values()) > 1
    assert sorted(many.scores("w3 w5 w5").collect()) == sorted(one.scores("w3 w5 w5").collect())
    weights = [{r.term: (r.df, round(r.idf, 9)) for r in x.frequencies().collect()} for x in (many, one)]
    assert weights[0] == weights[1]
    assert many.terms.count() == many.n_terms == len({w for _, w in want})
