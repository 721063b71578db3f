"""Where chunks lie, against all windows, and what they give back, against counted words."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from korvane.operators import alignment
from korvane.plans import registry

TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80), st.lists(st.integers(0, 4), max_size=80))
def test_common_is_the_longest_common_subsequence(a, b):
    assert alignment.common(a, b) == subsequence(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80), st.lists(st.lists(st.integers(0, 4), min_size=30, max_size=30), max_size=4))
def test_common_of_several_at_once(a, others):
    assert alignment.commons(a, others) == [subsequence(a, b) for b in others]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=60))
def test_marks_are_the_last_of_the_least_of_each_window(tokens):
    hashes = np.array(tokens, np.uint64)
    got = dict(zip(*[x.tolist() for x in alignment.marks(hashes)][::-1], strict=True))
    n = max(0, len(tokens) - alignment.SHINGLE + 1)
    run = lambda i: tuple(tokens[i : i + alignment.SHINGLE])
    shingle = {i: alignment.marks(hashes[i : i + alignment.SHINGLE])[0][0].astype(np.uint64) for i in range(n)}
    width = min(alignment.WINDOW, n)
    want = sorted({min(range(i, i + width), key=lambda j: (shingle[j], -j)) for i in range(n - width + 1)}) if n else []
    seen = Counter()
    kept = [i for i in want if (seen.update([run(i)]), seen[run(i)])[1] <= alignment.REPEATS]
    assert sorted(got) == kept and all(np.int64(got[i]).astype(np.uint64) == shingle[i] for i in kept)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAéÉ_9 \n.,-\U0001f600中x", max_size=60))
def test_tokens_have_their_places(text):
    hashes, begins, ends = alignment.positioned_tokens(text)
    want = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == want
    by_token = {}
    for h, (a, b) in zip(hashes.tolist(), want, strict=True):
        assert by_token.setdefault(text[a:b].lower(), h) == h
    assert len(set(by_token.values())) == len(by_token)


def test_a_shared_run_shares_a_mark():
    rng = np.random.default_rng(1)
    for _ in range(300):
        run = rng.integers(0, 1 << 63, alignment.WINDOW + alignment.SHINGLE - 1).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 30)).astype(np.uint64), run, rng.integers(0, 1 << 63, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(2))
        assert set(alignment.marks(a)[0].tolist()) & set(alignment.marks(b)[0].tolist())


def test_marks_of_a_repeating_text_are_few():
    same = np.full(5000, 7, np.uint64)
    assert len(alignment.marks(same)[0]) == alignment.REPEATS
    assert [len(x) for x in alignment.marks(same[:2])] == [0, 0] and len(alignment.marks(same[:3])[0]) == 1


def test_copies_and_changed_copies_are_found(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    documents, chunks, where = [], [], {}
    for d in range(12):
        ws = rng.choices(vocabulary, k=rng.choice([15, 80, 600]))
        documents.append((d, " ".join(ws)))
        for c in range(3):
            n = min(len(ws), 40)
            a = rng.randrange(len(ws) - n + 1)
            part = ws[a : a + n]
            if c:
                part = [w for w in part if rng.random() > 0.06]  # some words are lost
            where[d, c] = a, n, part, ws
            chunks.append((d, c, ", ".join(part).upper() if c == 2 else " ".join(part)))
        chunks.append((d, 9, " ".join(f"other{i}" for i in range(30))))
    chunks += [(0, 10, None), (0, 11, ""), (77, 1, "no such document at all " * 5), (None, 1, "a b c d e f g h i j")]
    documents += [(50, None), (51, "")]
    got = {(r.doc_id, r.chunk_no): r for r in alignment.locate(spark.createDataFrame(documents, "doc_id long, text string").repartition(3), spark.createDataFrame(chunks, "doc_id long, chunk_no long, text string"), 0.85).collect()}
    assert len(got) == len(chunks) - 1
    text = dict(documents)
    for (d, c), (a, n, part, ws) in where.items():
        r = got[d, c]
        if c == 0:
            assert r.matched and r.similarity == 1.0 and text[d][r.start : r.end] == " ".join(part)
        if c == 1:
            best = max(2 * subsequence(part, ws[i : i + len(part)]) / (len(part) + len(ws[i : i + len(part)])) for i in range(len(ws) - len(part) + 1))
            assert r.similarity >= 0.93 * best and abs(text[d][: r.start].count(" ") - a) <= n - len(part) + 1
    for d in range(12):
        assert not got[d, 9].matched
    for key in ((0, 10), (0, 11), (77, 1)):
        assert tuple(got[key])[2:] == (-1, -1, 0.0, False)


def test_punctuation_is_told_apart_only_as_tokens(spark):
    documents = spark.createDataFrame([(1, "One, two (three) four five six seven eight nine ten.")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, 0, "two (THREE) four five six seven eight")], "doc_id long, chunk_no long, text string")
    r = alignment.locate(documents, chunks).first()
    assert (r.start, r.end, r.similarity, r.matched) == (5, 42, 1.0, True)


def test_texts_move_once_and_a_document_is_cut_into_tokens_once(spark, monkeypatch):
    documents = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "one two three four"), (2, "four five six")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, 0, "c d e f g h i j"), (1, None, "c d e f g h i j"), (2, 0, "four five six"), (3, 0, "c d e f g h i j")], "doc_id long, chunk_no long, text string")
    found = alignment.locate(documents, chunks)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1
    rows = sorted((r.doc_id, -1 if r.chunk_no is None else r.chunk_no, r.start, r.end, r.similarity) for r in found.collect())
    assert rows == [(1, -1, -1, -1, 0.0), (1, 0, 4, 19, 1.0), (2, 0, -1, -1, 0.0), (2, 0, 0, 13, 1.0), (3, 0, -1, -1, 0.0)]
    calls, real = [], alignment.positioned_tokens
    monkeypatch.setattr(alignment, "positioned_tokens", lambda text: calls.append(text) or real(text))
    document = alignment.Located("a b c d e f g h i j k l m n")
    for part in ("c d e f g h i j", "e f g h i j k l"):
        alignment.best_place(document.tokens, real(part)[0], document.starts(real(part)[0]))
    assert calls == ["a b c d e f g h i j k l m n"]


def test_a_repeating_document(spark):
    documents = spark.createDataFrame([(1, "again and again " * 4000)], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, i, "again and again " * 20) for i in range(50)], "doc_id long, chunk_no long, text string")
    rows = alignment.locate(documents, chunks).collect()
    assert len(rows) == 50 and all(r.similarity == 1.0 and r.matched for r in rows)


def test_coverage_is_counted_in_words(spark):
    documents = [(1, "a b b c"), (2, None), (3, "x"), (4, ""), (5, "Ü ü z_1")]
    chunks = [(1, 0, "A b,"), (1, 1, "d d"), (3, 0, None), (4, 0, "new"), (5, 0, "ü. Ü"), (9, 0, "elsewhere")]
    got = {r.doc_id: (r.ratio, r.n_missing, r.n_added) for r in alignment.coverage_ratio(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(chunks, "doc_id long, chunk_no long, text string")).collect()}
    for d, text in documents:
        own, given_ = (Counter(w for t in ts for w in regex.findall(alignment.WORD, (t or "").lower())) for ts in ([text], [t for i, _, t in chunks if i == d]))
        both, total = sum((own & given_).values()), sum(own.values()) + sum(given_.values())
        assert got[d] == (pytest.approx(2 * both / total if total else 1.0, abs=1e-6), sum((own - given_).values()), sum((given_ - own).values()))
    assert len(got) == len(documents)


def test_coverage_of_rows_that_repeat_null_ids_and_empty_tables(spark):
    documents = spark.createDataFrame([("a", "x y", 1), ("a", "x", 2), (None, "lost words", 3), ("c", "x x x", 4)], "doc_id string, text string, words int")
    chunks = spark.createDataFrame([("a", 0, "x X z"), (None, 0, "lost words"), ("c", 0, "x"), ("c", 0, "x")], "doc_id string, chunk_no long, text string")
    rows = sorted((r.doc_id or "", r.ratio, r.n_missing, r.n_added) for r in alignment.coverage_ratio(documents, chunks).collect())
    assert rows == [("", 1.0, 0, 0), ("a", 0.666667, 1, 1), ("a", 0.666667, 1, 1), ("c", 0.8, 1, 0)]
    assert alignment.coverage_ratio(documents.limit(0), chunks).count() == 0
    assert {r.n_missing for r in alignment.coverage_ratio(documents, chunks.limit(0)).collect()} == {0, 3}


def test_coverage_counts_each_document_once_over_many_batches(spark):
    documents = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' same '), 1 + id % 7) AS text")
    chunks = documents.selectExpr("doc_id", "explode(sequence(0, 2)) AS chunk_no", "'same' AS text")
    rows = alignment.coverage_ratio(documents, chunks).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 3000
    for r in rows:
        n = 1 + r.doc_id % 7
        both = min(n, 3)
        assert (r.ratio, r.n_missing, r.n_added) == (pytest.approx(2 * both / (2 * n + 3), abs=1e-6), 2 * n - both, 3 - both)


def test_the_query_finds_the_middle_of_every_document(spark, sf):
    rows = registry.QUERIES["fuzzy_locate"](spark, sf).collect()
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(documents)
    long = [r for r in rows if len((documents[r.doc_id] or "").split(" ")) >= 200]
    assert long and np.mean([r.similarity > 0.85 for r in long]) > 0.97
