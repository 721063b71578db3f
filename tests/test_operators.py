"""Operators on small tables: the cases that their docstrings define."""

from __future__ import annotations

import itertools
import json
import math
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korvane.functions import models, text
from korvane.operators import chunking, corrective, coverage, history, ingest, lexical, search, sessions, stats, transcript, validation, vector
from korvane.sources import readers


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


# --- vectors ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 1.0], "a"), (4, [0.0, 0.0], None), (5, None, "c")]
    return spark.createDataFrame(rows, "chunk_id int, embedding array<float>, source_document string")


def test_top_k_orders_nulls_last_and_ties_by_id(vectors):
    found = vector.top_k(vectors, [1.0, 1.0], 5).collect()
    assert [r.chunk_id for r in found] == [3, 1, 2, 4, 5]
    assert found[3].similarity_score is None


def test_top_k_by_distance(vectors):
    assert [r.chunk_id for r in vector.top_k(vectors, [0.0, 0.0], 2, metric="l2").collect()] == [4, 1]


@pytest.mark.parametrize("k", [0, -1])
def test_top_k_needs_a_positive_k(vectors, k):
    with pytest.raises(ValueError):
        vector.top_k(vectors, [1.0, 0.0], k)


def test_filters_are_joined_by_or_and_unknown_ones_dropped(vectors):
    ids = lambda f: {r.chunk_id for r in vector.metadata_filter(vectors, f).collect()}
    assert ids({"source_document": "a", "colour": "x"}) == {1, 3}
    assert ids({"colour": "x"}) == ids(None) == {1, 2, 3, 4, 5}
    assert ids({"source_document": None}) == set()


def test_bad_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0])], "id int, embedding array<double>")
    assert {r.id for r in vector.bad_vectors(rows, 2).collect()} == {2, 3, 4, 5, 6}


def test_models(spark):
    assert one(spark, models.letter_embedding, "Abba")[:3] == [2.0, 2.0, 0.0]
    assert one(spark, lambda t: models.overlap_score("a b c d", t), "A x B") == 0.5
    assert one(spark, lambda t: models.overlap_score(" ", t), "a") == 0.0
    assert one(spark, models.normalised, [3.0, 4.0], "array<double>") == [0.6, 0.8]
    assert one(spark, models.normalised, [0.0, 0.0], "array<double>") == [0.0, 0.0]
    assert one(spark, models.mean_pooled, [[1.0, 0.0], [1.0, 0.0]], "array<array<double>>") == [1.0, 0.0]
    assert one(spark, models.mean_pooled, [], "array<array<double>>") is None


def test_strategies(spark):
    rows = spark.createDataFrame([(1, "aa bb"), (2, "bb"), (3, "cc dd")], "chunk_id int, chunk_text string").withColumn("embedding", models.letter_embedding(F.col("chunk_text")))
    assert [r.chunk_id for r in search.search("Simple", rows, "bb", 1).collect()] == [2]
    assert [r.chunk_id for r in search.search("rerank", rows, "aa bb", 2).collect()] == [1, 2]
    found = search.search("advanced", rows, "cc", 2, ["aa", "bb", "cc", "cc"]).collect()
    assert found[0].chunk_id == 3 and len({r.chunk_id for r in found}) == 2
    with pytest.raises(ValueError):
        search.search("other", rows, "x", 1)
    with pytest.raises(AssertionError):
        search.search("rerank", rows, "x", 1, score=None)
    with pytest.raises(ValueError):
        search.search("simple", rows, "  ", 1)


def test_a_scorer_that_fails_leaves_the_order(spark):
    rows = spark.createDataFrame([(1, "aa bb", 0.9), (2, "bb", 0.8), (3, "cc", None)], "chunk_id int, chunk_text string, similarity_score double")
    broken = lambda query, text: F.raise_error(F.concat(F.lit("no model for "), text)).cast("double")
    with pytest.warns(RuntimeWarning, match="no model"):
        assert [(r.chunk_id, r.rerank_score) for r in search.rerank_or_keep(rows, "bb", 2, broken).collect()] == [(1, None), (2, None)]
    assert [(r.chunk_id, r.rerank_score) for r in search.rerank_or_keep(rows, "bb", 2, models.overlap_score).collect()] == [(1, 1.0), (2, 1.0)]
    assert [r.rerank_score for r in search.rerank_or_keep(rows.limit(1), "bb", 2, models.overlap_score).collect()] == [None]
    assert search.rerank_or_keep(rows.limit(0), "bb", 2, models.overlap_score).count() == 0


def test_rerank_of_many_requests(spark):
    rows = spark.createDataFrame([(1, ["a", "b a", "c"]), (2, []), (3, ["b", None])], "request int, texts array<string>")
    assert [tuple(r) for r in search.rerank_indexed(rows, "a b").collect()] == [(1, 1, 1.0), (1, 0, 0.5), (1, 2, 0.0), (3, 0, 0.5), (3, 1, 0.0)]
    assert [tuple(r) for r in search.rerank_indexed(rows.where("request = 1").drop("request"), "a").collect()] == [(0, 1.0), (1, 1.0), (2, 0.0)]


# --- keywords and hybrid ----------------------------------------------------------------------------------------------


def test_min_max_cases(spark):
    scaled = lambda xs: [r.s for r in lexical.min_max(spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id int, v double"), "v", "s").orderBy("id").collect()]
    assert scaled([10, 5, 0]) == [1.0, 0.5, 0.0]
    assert scaled([5, 5, 5]) == [0.5, 0.5, 0.5]
    assert scaled([7]) == [0.5]
    assert scaled([]) == []


def test_fusion_is_over_the_union(spark):
    v = spark.createDataFrame([(1, 1.0), (2, 0.0)], "id int, vec double")
    k = spark.createDataFrame([(2, 4.0), (3, 0.0)], "id int, bm25 double")
    assert {r.id: r.score for r in lexical.fuse(v, k, 0.5).collect()} == {1: 0.5, 2: 0.5, 3: 0.0}
    with pytest.raises(ValueError):
        lexical.fuse(v, k, 1.5)


def test_parents_once_and_children_without_a_parent_stay(spark):
    scored = spark.createDataFrame([("c1", "p", 0.9), ("c2", "p", 0.8), ("c3", "gone", 0.7), ("d", None, 0.6)], "id string, parent_id string, score double")
    parents = spark.createDataFrame([("p",)], "id string")
    assert [(r.id, r.via) for r in lexical.lift_parents(scored, parents, 5).collect()] == [("p", "c1"), ("c3", "c3"), ("d", "d")]


BM25_DOCS = [(1, "x a"), (2, "x b"), (3, "x c"), (4, None), (5, "d d e x"), (6, ""), (7, "f A")]


def okapi(docs, query):
    """The formula, word by word."""
    words = {i: (t or "").lower().split() for i, t in docs}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    score = lambda ws: sum(idf[q] * ws.count(q) * 2.5 / (ws.count(q) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for q in query.lower().split() if q in idf)
    return {i: round(score(ws), 6) for i, ws in words.items()}


def test_bm25_of_a_word_in_most_documents_is_small_but_positive(spark, tmp_path):
    lexical.add_documents(spark.createDataFrame(BM25_DOCS[:4], "doc_id int, text string"), str(tmp_path / "i"))
    index = lexical.read_index(spark, str(tmp_path / "i"))
    scores = {r.id: r.bm25 for r in index.scores("a x").collect()}
    assert scores[1] > scores[2] == scores[3] and scores[4] == 0.0
    for query in (" ", "nothing"):
        assert {r.bm25 for r in index.scores(query).collect()} == {0.0}


def test_bm25_of_an_index_that_grows(spark, tmp_path):
    path = str(tmp_path / "i")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, text string")
    for end, rows in ((4, BM25_DOCS[:4]), (6, BM25_DOCS[4:6]), (7, BM25_DOCS[6:]), (7, [])):
        lexical.add_documents(frame(rows), path)
        index = lexical.read_index(spark, path)
        assert index.n == end
        for query in ("a x", "D d a", "x"):
            assert {r.id: r.bm25 for r in index.scores(query).collect()} == pytest.approx(okapi(BM25_DOCS[:end], query), abs=2e-6)
    assert {r.term: r.df for r in index.frequencies().collect()} == {"x": 4, "a": 2, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}
    assert lexical.hybrid_stats(index, 0.5).first()[:3] == (7, 1.714286, 7)


def test_a_search_reads_the_folders_of_its_terms(spark, tmp_path):
    lexical.add_documents(spark.createDataFrame(BM25_DOCS, "doc_id int, text string"), str(tmp_path / "i"))
    plan = lexical.read_index(spark, str(tmp_path / "i")).scores("a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(term,a)" in plan


def test_an_index_of_nothing(spark, tmp_path):
    lexical.add_documents(spark.createDataFrame([], "doc_id int, text string"), str(tmp_path / "i"))
    index = lexical.read_index(spark, str(tmp_path / "i"))
    assert index.scores("a").count() == 0 and index.frequencies().count() == 0 and lexical.hybrid_stats(index, 0.5).first().n_documents == 0


# --- history and texts ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "human", "one"), (1, 2, "ai", "two"), (1, 3, "human", ""), (1, 4, "human", "three"), (2, 0, "ai", "only"), (3, 0, "human", None)]
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")


def test_history(messages):
    query = lambda n: {r.conv_id: r.query for r in history.retrieval_query(messages, n).collect()}
    assert query(1) == {1: "three", 2: "", 3: ""}
    assert query(2) == {1: "three", 2: "", 3: ""}  # the empty one is sliced in, then left out
    assert query(0)[1] == "one\nthree"
    context = {r.conv_id: r.context for r in history.context(messages, 3, 1).collect()}
    assert context == {1: "Assistant: two\nUser: ", 2: "", 3: ""}


def test_classification(spark):
    rows = spark.createDataFrame([(1, 0, "user", "I feel sad"), (1, 1, "user", "Hi there"), (1, 2, "user", "This thing")], "conv_id int, turn int, role string, text string")
    got = {r.turn: (r.agent, r.intent) for r in history.classify_messages(rows).collect()}
    assert got == {0: ("emotional_support", "retrieve"), 1: ("rag_agent", "respond"), 2: ("rag_agent", "retrieve")}


def test_scalars(spark):
    assert one(spark, text.normalize_output, ' "Retrieve"\n') == "retrieve"
    assert one(spark, text.intent_or_default, "whatever") == "retrieve"
    assert one(spark, text.seconds_of, "01:02:03.5") == 3723.5
    assert one(spark, text.seconds_of, "02:03.5") == 123.5
    assert one(spark, text.seconds_of, "x") == 0.0
    with pytest.raises(Exception, match="not a time"):
        one(spark, lambda c: text.seconds_of(c, strict=True), "x")
    assert one(spark, lambda c: text.breadcrumb(c, F.lit(""), F.lit("b")), "a") == "a > b"
    assert one(spark, lambda c: text.breadcrumb(c), "") == "Unknown Source"
    assert one(spark, lambda c: text.expansion_queries(c, F.lit("q")), "SPECIFIC: a\nnoise\nKEYWORDS: b") == ["a", "b", "q", "q"]
    assert one(spark, lambda c: text.multi_queries(c, F.lit("q")), "a\n\nb\nc\nd") == ["q", "a", "b", "c"]
    frame = one(spark, lambda c: text.sse_encode(F.struct(c.alias("type"))), "done")
    assert frame == 'data: {"type":"done"}\n\n'
    assert one(spark, lambda c: text.sse_decode(c, "type string"), frame).type == "done"
    assert one(spark, lambda c: text.sse_decode(c, "type string"), frame[:-1]) is None


# --- chunks -----------------------------------------------------------------------------------------------------------


def test_structure_table(spark):
    table = "title\tlevel\tparent\tsummary\tstart\tend\tis_table\n```\nA\t1\tROOT\ts\tw\t[EMPTY]\tfalse\n\nB\t2\tA\ts\t[EMPTY]\t[EMPTY]\tTrue\n"
    rows = chunking.parse_structure(spark.createDataFrame([("d", table)], "document_id string, text string"))
    assert [tuple(r) for r in rows.orderBy("idx").collect()] == [("d", 0, "A", 1, None, "s", "w", "", False), ("d", 1, "B", 2, "A", "s", "", "", True)]
    assert [r.chunk_id for r in chunking.chunk_ids(rows).collect()] == ["d_chunk_001"]
    derived = {r.title: r.subsection_title for r in chunking.derive_metadata(rows).collect()}
    assert derived == {"A": ["B"], "B": []}
    with pytest.raises(Exception, match="not 7 fields"):
        chunking.parse_structure(spark.createDataFrame([("d", "a\tb")], "document_id string, text string")).collect()


def test_tags(spark):
    rows = spark.createDataFrame([("[A]x[/A][A] y\nz [/A][C]",), ("nothing",), (None,)], "text string")
    got = [(r.a, r.b, r.missing_tags) for r in chunking.parse_tags(rows, ["A", "B"]).collect()]
    assert got[0] == ("y\nz", None, ["B"]) and got[1] == (None, None, ["A", "B"]) and got[2][0] is None
    problems = {
        "[A]x[/A]": [], "[A]x[/A][A][C]": ["uneven A", "unexpected C"], "[/A]x[A]": ["unordered A"], "": ["missing A"], None: ["missing A"], "[A][A]x[/A][/A]": [], "[A]x[/A][/A][A]": ["unordered A"],
    }
    for tagged, want in problems.items():
        assert one(spark, lambda t: chunking.tag_problems(t, ["A"]), tagged) == want
    assert one(spark, lambda t: chunking.tag_problems(t, ["A"], strict=False), "[A]x[/A][C]") == []
    assert one(spark, lambda t: chunking.has_tag(t, "A"), "[A]x[/A]") and not one(spark, lambda t: chunking.has_tag(t, "A"), None)


def test_responses(spark):
    assert one(spark, chunking.response_problem, " ") == "empty"
    assert one(spark, chunking.response_problem, "```x") == "fenced"
    assert one(spark, chunking.response_problem, "Here is a table") == "chatty"
    assert one(spark, chunking.response_problem, "a\tb") is None


def split_by_definition(text, size, overlap, separators):
    """The public recursive splitter, written down from its description with plain lists."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    pieces = [p for p in re.split(f"(?={re.escape(sep)})", text) if p] if len(sep) == 1 else None
    if pieces is None:
        pieces, rest = [], text
        while sep and sep in rest[1:]:
            cut = rest.index(sep, 1) if rest.startswith(sep) is False else rest.index(sep, len(sep)) if sep in rest[len(sep) :] else -1
            if cut < 0:
                break
            pieces.append(rest[:cut])
            rest = rest[cut:]
        pieces = [*pieces, rest] if sep else list(text)
        pieces = [p for p in pieces if p]
    out, run = [], []

    def merged(run):
        made, current = [], []
        for piece in run:
            if sum(map(len, current)) + len(piece) > size:
                made.append("".join(current))
                while current and (sum(map(len, current)) > overlap or sum(map(len, current)) + len(piece) > size):
                    current = current[1:]
            current = [*current, piece]
        return [m.strip() for m in [*made, "".join(current)] if m.strip()]

    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
            continue
        out += merged(run)
        run = []
        out += split_by_definition(piece, size, overlap, finer) if finer else [piece]
    return out + merged(run)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200), st.integers(1, 30), st.integers(0, 29))
def test_pieces_by_definition(whole, size, overlap):
    overlap = min(overlap, size - 1)
    parts = chunking.pieces(whole, size, overlap)
    assert parts == split_by_definition(whole, size, overlap, list(chunking.SEPARATORS))
    assert all(0 < len(p) <= size and p in whole and (p == p.strip() or size == 1) for p in parts)  # a part that nothing cuts stays as it is
    covered = set()
    for p in parts:
        for m in re.finditer(f"(?={re.escape(p)})", whole):
            covered |= set(range(m.start(), m.start() + len(p)))
    assert all(i in covered for i, c in enumerate(whole) if not c.isspace())


def test_pieces_of_known_texts():
    assert chunking.pieces("one two three four", 9, 4) == ["one two", "three", "four"]
    assert chunking.pieces("a. b. c", 4, 0) == ["a. b", ". c"]
    assert chunking.pieces("abcdef", 3, 1) == ["abc", "cde", "ef"] and chunking.pieces(" \n ", 5, 0) == [] and chunking.pieces("", 5, 0) == []


def test_parents_and_children_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = set()
    for r in docs.collect():
        n = 0
        for i, parent in enumerate(chunking.pieces(r.text or "", 500, 20)):
            at = r.text.find(parent)
            for child in chunking.pieces(parent, 100, 20):
                inside = parent.find(child)
                if at >= 0 and inside >= 0:
                    want.add((r.doc_id, i, at, at + len(parent), n, at + inside, at + inside + len(child), child))
                n += 1
    got = [tuple(r) for r in chunking.parent_child_chunks(docs, "doc_id", "text", 500, 100, 20).collect()]
    assert len(got) == len(want) and set(got) == want


def test_chunk_metadata(spark):
    got = one(spark, chunking.chunk_metadata, " C\tS \tnone\tabout\n")
    assert tuple(got) == ("C", "S", None, "about") and one(spark, chunking.chunk_metadata, None) is None
    with pytest.raises(Exception, match="not 4 fields"):
        one(spark, chunking.chunk_metadata, "C\tS")
    assert one(spark, chunking.prefix_problem, "This chunk is from x") is None and one(spark, chunking.prefix_problem, "This chunk") == "length"
    assert one(spark, chunking.prefix_problem, None) == "length" and one(spark, chunking.prefix_problem, "That chunk is from the end") == "start"


# --- transcripts and coverage -----------------------------------------------------------------------------------------


def test_captions(spark):
    vtt = "WEBVTT\n\n1\n00:01.000 --> 00:02.000\nAnn Lee: hello <b>you</b>\n\n00:02.000 --> 00:03.500\n<v Bob>well  then\n\n00:04.000 --> 00:05.000\n\n"
    rows = transcript.cues(spark.createDataFrame([("v", vtt)], "video_id string, value string")).orderBy("idx").collect()
    assert [(r.start, r.end, r.speaker, r.text) for r in rows] == [("00:01.000", "00:02.000", "Ann Lee", "hello you"), ("00:02.000", "00:03.500", "Bob", "well then")]
    assert one(spark, transcript.plain_text, vtt) == "1 Ann Lee: hello <b>you</b> <v Bob>well then"
    assert one(spark, transcript.video_title, "video_12_A_talk_20240101") == "A talk"
    assert one(spark, transcript.video_title, "other") == "other"


def merged(labels):
    """Turns by walking: a new one where both speakers are known and differ."""
    turns, current = [], None
    for i, s in enumerate(labels):
        if turns and (current is None or s is None or s == current):
            turns[-1].append(i)
        else:
            turns.append([i])
            current = s
    return [(t[0], t[-1]) for t in turns]


def test_merged_speakers_by_brute_force(spark):
    cases = list(itertools.product([None, "a", "b"], repeat=5))
    rows = [(k, i, s, str(i)) for k, labels in enumerate(cases) for i, s in enumerate(labels)]
    df = spark.createDataFrame(rows, "v int, idx int, speaker string, text string")
    got: dict[int, list] = {}
    for r in transcript.merge_speakers(df, "v", "idx").orderBy("v", "first").collect():
        got.setdefault(r.v, []).append((r.first, r.last))
    assert got == {k: merged(labels) for k, labels in enumerate(cases)}


def test_overlap_by_brute_force(spark):
    ranges = [("v", a, a + 7) for a in range(0, 60, 5)]
    captions = [("v", i, a, a + n) for i, (a, n) in enumerate([(0, 3), (3, 0), (4, 30), (50, 1), (56, 9)])]
    got = transcript.overlapping(spark.createDataFrame(ranges, "k string, start long, end long"), spark.createDataFrame(captions, "k string, i int, char_start long, char_end long"), "k", 10)
    want = {(s, i) for _, s, e in ranges for _, i, a, b in captions if b > s and a < e}
    rows = [(r.start, r.i) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_gaps_by_brute_force(spark):
    cases = {1: ([(2, 4), (3, 6), (6, 8)], 10), 2: ([], 5), 3: ([(0, 5)], 5), 4: ([], 0), 5: ([(0, 9), (2, 3), (12, 20)], 30)}
    intervals = spark.createDataFrame([(k, a, b) for k, (ivs, _) in cases.items() for a, b in ivs], "k int, start int, end int")
    lengths = spark.createDataFrame([(k, n) for k, (_, n) in cases.items()], "k int, length int")
    want = set()
    for k, (ivs, n) in cases.items():
        open_ = [not any(a <= i < b for a, b in ivs) for i in range(n)]
        at = 0
        for free, run in itertools.groupby(open_):
            size = len(list(run))
            if free:
                want.add((k, at, at + size))
            at += size
    assert {tuple(r) for r in coverage.gaps(intervals, lengths, "k").collect()} == want
    percent = {r.k: r.percent for r in coverage.summary(intervals, lengths, "k").collect()}
    assert percent[1] == 60.0 and percent[2] == 0.0 and percent[4] == 100.0


def test_global_ids_are_gapless(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    got = transcript.renumber(rows, ["x"], 16).orderBy("x").collect()
    assert [r.global_id for r in got] == list(range(5000))


# --- sessions, ingest, validation, statistics -------------------------------------------------------------------------

NOW = datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def stored(spark):
    rows = [("s1", "u1", NOW), ("s2", "u1", NOW - timedelta(seconds=60)), ("s3", "u2", NOW - timedelta(seconds=61))]
    return spark.createDataFrame(rows, "session_id string, user_id string, updated_at timestamp")


def test_time_to_live(stored):
    assert {r.session_id for r in sessions.live(stored, NOW, 60).collect()} == {"s1", "s2"}
    assert [r.session_id for r in sessions.expired(stored, NOW, 60).collect()] == ["s3"]
    assert [r.session_id for r in sessions.of_user(stored, "u1", NOW, 60).collect()] == ["s1", "s2"]


def test_create_or_load(spark, stored):
    asked = spark.createDataFrame([(1, "s1", "u1"), (2, "s1", "u2"), (3, "s3", "u2"), (4, None, "u1"), (5, "no", "u1")], "request_id int, session_id string, user_id string")
    got = {r.request_id: r.outcome for r in sessions.create_or_load(asked, stored, NOW, 60).collect()}
    assert got == {1: "loaded", 2: "forbidden", 3: "created", 4: "created", 5: "created"}


def test_nothing_follows_a_terminal_event(spark):
    rows = spark.createDataFrame([("a", 1, "token", "x"), ("a", 2, "stage", "s"), ("a", 3, "done", None), ("a", 4, "token", "y"), ("b", 1, "token", "z")], "k string, seq int, type string, content string")
    is_ = lambda t: F.when(F.col("type") == t, F.col("content"))
    got = {r.k: (r.answer, r.n_tokens, r.stage, r.status) for r in sessions.accumulate(rows, "k", "seq", is_("token"), is_("stage")).collect()}
    assert got == {"a": ("x", 1, "s", "done"), "b": ("z", 1, None, "open")}


def test_ingest(spark, tmp_path):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), (None, 1)], "k string, v int")
    path = str(tmp_path / "t")
    ingest.append_absent(new, path, "k", ["v"])
    ingest.append_absent(new, path, "k", ["v"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 1)]
    merged_ = ingest.upsert(spark.createDataFrame([("a", 1), ("c", 3)], "k string, v int"), spark.createDataFrame([("a", 9)], "k string, v int"), "k")
    assert sorted(map(tuple, merged_.collect())) == [("a", 9), ("c", 3)]


def test_embedding_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0])], "chunk_id int, embedding array<float>")
    meta = dict.fromkeys(ingest.META, "1")
    ingest.write_embeddings(rows, str(tmp_path / "e"), meta)
    back, found = ingest.read_embeddings(spark, str(tmp_path / "e"), 1)
    assert found == meta and back.count() == 1
    with pytest.raises(ValueError):
        ingest.read_embeddings(spark, str(tmp_path / "e"), 2)
    with pytest.raises(AssertionError):
        ingest.write_embeddings(rows.limit(0), str(tmp_path / "f"), meta)
    with pytest.raises(ValueError):
        ingest.write_embeddings(rows, str(tmp_path / "f"), {})


def test_readers(spark, tmp_path):
    folder = tmp_path / "c" / "sub"
    folder.mkdir(parents=True)
    chunk = {"chunk_id": "d_chunk_001", "source_document": "d", "chunk_text": "x", "token_count": 3, "metadata": {"chapter_title": "C"}}
    (folder / "d_chunk_001.json").write_text(json.dumps(chunk, indent=1))
    (folder / "d_chunk_002.json").write_text(json.dumps({"chunk_id": "d_chunk_002"}))
    (folder / "d_chunk_003.json").write_text("{not json")
    good, bad = readers.chunk_files(spark, str(tmp_path / "c"))
    assert [(r.chunk_id, r.chapter_title, r.subsection_title, r.summary) for r in good.collect()] == [("d_chunk_001", "C", [], "")]
    assert bad.count() == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.b.md").write_text("hello")
    (tmp_path / "docs" / "empty.txt").write_text("  ")
    assert [(r.document_id, r.content) for r in readers.documents(spark, str(tmp_path / "docs")).collect()] == [("a.b", "hello")]
    (tmp_path / "docs" / "m.json").write_text(json.dumps([{"id": "1", "name": "n", "uses": None}]))
    assert readers.json_documents(spark, str(tmp_path / "docs" / "m.json"), ["name", "uses"]).first().content == "name: n\nuses: "
    (tmp_path / "docs" / "t.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhi\n")
    assert [(r.video_id, r.text) for r in readers.captions(spark, str(tmp_path / "docs")).collect()] == [("t", "hi")]
    with pytest.raises(ValueError):
        readers.require(good, ["nope"])


def test_validation(spark):
    rows = spark.createDataFrame([("d_chunk_001", "x", "T", 5, "long enough summary"), ("bad", " ", None, 0, "tbd")], "chunk_id string, chunk_text string, chapter_title string, token_count int, summary string")
    got = {(r.id, r.rule) for r in validation.violations(rows, validation.chunk_rules()).collect()}
    assert got == {("bad", x) for x in ("chunk_id", "chunk_text", "title", "token_count", "summary_length", "summary_placeholder")}
    assert validation.schema_difference(rows, {"chunk_id": "string", "token_count": "bigint", "more": "int"})[0] == {"more"}
    assert validation.table_name("chunks_1") == "`chunks_1`"
    with pytest.raises(ValueError):
        validation.table_name("x; drop")
    sections = spark.createDataFrame([("d", "A", None), ("d", "B", "A"), ("d", "C", "Z")], "document_id string, title string, parent_section string")
    assert [r.title for r in validation.missing_parents(sections).collect()] == ["C"]


def test_rules_of_sections_metadata_and_messages(spark):
    sections = spark.createDataFrame([("a", "T", 1, "long enough summary", "w", ""), ("b", "", 6, "", "x" * 1001, None), ("c", "T", None, "short", "w", "y" * 1001)], "chunk_id string, title string, level int, summary string, start_words string, end_words string")
    got = {(r.id, r.rule) for r in validation.violations(sections, validation.section_rules()).collect()}
    assert got == {("b", x) for x in ("title", "level", "summary_length", "summary_short", "start_words")} | {("c", x) for x in ("level", "summary_short", "end_words")}
    rows = spark.createDataFrame([("a", "C", "S", "a summary of it", 5), ("b", " TBA ", "...", "todo", 1001), ("c", None, "", None, None)], "chunk_id string, chapter_title string, section_title string, summary string, token_count int")
    found = {(r.id, r.rule) for r in validation.violations(rows, validation.metadata_rules()).collect()}
    assert found == {("b", x) for x in ("chapter_title_placeholder", "section_title_placeholder", "summary_placeholder", "summary_too_short")} | {("c", "summary_too_short")}
    whole = validation.violations(rows, validation.document_rules())
    assert {(r.id, r.rule, r.severity) for r in whole.collect()} == {("b", "too_long", "error"), ("c", "chapter_title", "error"), ("c", "section_title", "error"), ("c", "summary", "warning")}
    assert tuple(validation.outcome(whole).first()) == (3, 1, False)
    warned = whole.where("severity = 'warning'")
    assert validation.outcome(warned).first().passed and not validation.outcome(warned, strict=True).first().passed and validation.outcome(whole.limit(0), True).first().passed
    messages = spark.createDataFrame([("a", "hi", None), ("b", "", "x"), ("c", "y" * 5001, "0123abcd-0000-4000-8000-0123456789AB")], "chunk_id string, text string, session_id string")
    assert {(r.id, r.rule) for r in validation.violations(messages, validation.message_rules()).collect()} == {("b", "text"), ("b", "session_id"), ("c", "text")}
    ratios = spark.createDataFrame([("a", 0.995), ("b", 0.5), ("c", 1.5), ("d", None)], "doc string, ratio double")
    assert {(r.id, r.rule) for r in validation.coverage_violations(ratios, "doc").collect()} == {("b", "coverage"), ("c", "ratio"), ("d", "ratio")}
    good, bad = validation.accepted(rows, validation.document_rules())
    assert [r.chunk_id for r in good.collect()] == ["a"] and {r.chunk_id: r.reasons for r in bad.collect()} == {"b": ["too_long"], "c": ["chapter_title", "section_title"]}
    reports = spark.createDataFrame([("x", 2), ("y", 1), ("z", None)], "doc string, total int")
    held = spark.createDataFrame([("x",), ("x",)], "doc string")
    assert {tuple(r) for r in validation.count_mismatches(reports, held, "doc", "total").collect()} == {("y", 1, 0), ("z", None, 0)}
    with pytest.raises(ValueError):
        validation.require_rows(held.limit(0))
    with pytest.raises(ValueError):
        validation.table_name("chunks\n")


def test_work_is_resumed(spark, tmp_path):
    path, asked = str(tmp_path / "store"), []

    def compute(rows):
        asked.append(sorted(r.k for r in rows.collect()))
        return rows.withColumn("v", F.upper("k"))

    work = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    assert {tuple(r) for r in ingest.resumed(work("a", "b"), path, "k", compute).collect()} == {("a", "A"), ("b", "B")}
    assert {tuple(r) for r in ingest.resumed(work("b", "c"), path, "k", compute).collect()} == {("b", "B"), ("c", "C")}
    assert asked == [["a", "b"], ["c"]]
    assert tuple(stats.store_stats(spark, path).first())[0] >= 2


def test_tables_are_made_counted_and_dropped(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 1, "b")], "conv_id int, turn int, text string")
    assert ingest.write_counted(rows, str(tmp_path / "n")) == 3 and stats.table_size_mb(spark.read.parquet(str(tmp_path / "n"))) >= 0
    with pytest.raises(ValueError):
        ingest.write_counted(rows.limit(0), str(tmp_path / "m"))
    for _ in range(2):
        ingest.append_messages(rows, str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, 0, "a"), (1, 1, "b")]
    ingest.drop_table(spark, "made_here")
    assert ingest.create_table(spark, "made_here", "a int") and not ingest.create_table(spark, "made_here", "a int")
    spark.range(3).select(F.col("id").cast("int").alias("a")).write.mode("append").insertInto("made_here")
    assert ingest.clear_table(spark, "made_here") == 3 and spark.table("made_here").count() == 0
    ingest.drop_table(spark, "made_here")
    assert not spark.catalog.tableExists("made_here")
    assert ingest.touched(rows, "2024-01-01").first().updated_at == datetime(2024, 1, 1)
    ingest.write_report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_sessions_deleted_and_cleared(stored):
    assert {r.session_id for r in sessions.deleted(stored, stored.where("session_id = 's1'")).collect()} == {"s2", "s3"}
    left, n = sessions.clear_expired(stored, NOW, 60)
    assert n == 1 and {r.session_id for r in left.collect()} == {"s1", "s2"}


def test_texts_for_users_and_models(spark):
    shown = spark.createDataFrame([("respond", ["a"], "x"), ("respond", ["internal-llm"], "x"), ("retrieve", None, ""), ("supervisor", [], "x"), ("rag_agent", None, "x")], "n string, t array<string>, x string")
    assert [r.s for r in shown.select(text.shown_to_user(F.col("n"), F.col("t"), F.col("x")).alias("s")).collect()] == [True, False, False, False, True]
    assert one(spark, text.sse_events, ': hi\n\ndata: {"a":1}\n\nevent: x\n\ndata: {bad\n\ndata: {"a":2}\n\ndata: {"a"') == ['{"a":1}', '{"a":2}']
    assert one(spark, text.sse_events, None) == []
    items = [("a > b", "t"), ("", None)]
    got = one(spark, text.documents_markdown, items, "array<struct<source:string,text:string>>")
    assert got == "# Retrieved Information\n\n## Source 1: a > b\n\n### Content:\nt\n\n---\n\n## Source 2: Unknown Source\n\n### Content:\nNo content.\n\n---\n\n"
    assert one(spark, text.agent_or_error, " 'Rag_Agent' ") == "rag_agent"
    with pytest.raises(Exception, match="not an agent"):
        one(spark, text.agent_or_error, "x")
    assert one(spark, lambda c: text.event_type(c, F.lit("started")), "retrieval") == "retrieval_start" and one(spark, lambda c: text.event_type(c, F.lit("done")), "retrieval") == "retrieval_complete"
    assert one(spark, lambda c: text.storage_kb(c, 4), 1024, "int") == 4.0
    assert one(spark, lambda c: models.rerank_prompt("q", c), "d").startswith("<Instruct>: Given a web search query")
    rows = models.answered(spark.createDataFrame([("first\nsecond",), (None,)], "p string"), F.col("p"))
    assert [r.response for r in rows.collect()] == ["first", ""]


def test_token_count_by_a_vocabulary(spark):
    import public_tokenizers

    count = models.bpe_token_count(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = spark.createDataFrame([("hello world",), ("",), (None,)], "t string")
    assert [r.n for r in rows.select(count(F.col("t")).alias("n")).collect()] == [2, 0, 0]


def test_full_history(messages):
    got = {r.conv_id: r.history for r in history.full_history(messages).collect()}
    assert got == {1: "User: one\nAssistant: two\nUser: \nUser: three", 2: "Assistant: only", 3: "User: "}
    assert {r.history for r in history.full_history(messages.where("role = 'system'")).collect()} == {"No prior messages available."}


def test_ranges_without_a_caption(spark):
    captions = spark.createDataFrame([("v", 1, 0, 4, "A", "00:00:01.000", "00:00:02.000"), ("v", 2, 5, 9, None, "00:00:02.000", "00:00:03.000")], "k string, i int, char_start long, char_end long, speaker string, time_start string, time_end string")
    ranges = spark.createDataFrame([("v", 0, 4), ("v", 50, 60), ("w", 0, 4)], "k string, start long, end long")
    found = transcript.times_and_speakers(ranges, captions, "k", "i")
    timed = {(r.k, r.start): (r.first, r.last, r.speakers, r.time_start, r.time_end) for r in transcript.time_strings(found, captions, "k", "i").collect()}
    assert timed == {("v", 0): (1, 1, "A", "00:00:01.000", "00:00:02.000"), ("v", 50): (1, 2, "", "00:00:01.000", "00:00:03.000"), ("w", 0): (None, None, "", "00:00:00.000", "00:00:00.000")}


def test_statistics_of_matches_and_durations(spark):
    assert tuple(stats.match_counts(spark.createDataFrame([(True,), (False,), (None,)], "matched boolean")).first()) == (1, 2)
    assert tuple(stats.total_duration(spark.createDataFrame([(3600,), (3725,), (None,)], "duration int")).first()) == (3, 7325, 2, 2)
    times = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1, 250000))], "a timestamp, b timestamp")
    assert times.select(stats.duration_seconds(F.col("a"), F.col("b")).alias("s")).first().s == 1.25


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "source_document string, token_count int")
    assert tuple(stats.table_stats(none).first()) == (0, 0, 0.0)
    assert tuple(stats.batch_report(none).first()) == (0, 0, 0, 0.0)
    graded = spark.createDataFrame([(1, "0.9"), (1, "x"), (1, "0.1"), (2, "0.2")], "q int, grade string")
    got = {r.q: (r.quality, r.n_kept, r.confidence) for r in stats.retrieval_quality(graded, "q").collect()}
    assert got == {1: (0.5, 2, round(0.7 * 0.7 + 0.3 * 0.4, 6)), 2: (0.2, 0, 0.0)}


def test_corrective_search_rewrites_until_it_is_good(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "chunk_id int, chunk_text string").withColumn("embedding", models.letter_embedding(F.col("chunk_text")))
    got = corrective.corrective_search(rows, "alpha zzz yyy xxx", 2).collect()
    assert {r["query"] for r in got} == {"alpha"} and all(r.kept for r in got)
    assert {(r.confidence, r.outcome) for r in got} == {(0.82, "answer")}
    none = corrective.corrective_search(rows, "zzz yyy", 2).collect()
    assert {(r.confidence, r.outcome) for r in none} == {(0.0, "insufficient")} and not any(r.kept for r in none)


# --- sources and small operators --------------------------------------------------------------------------------------


def test_captions_of_the_first_files(spark, tmp_path):
    for name in ("video_12_a", "video_3_b_20240101", "video_2_c"):
        (tmp_path / f"{name}.vtt").write_text(f"WEBVTT\n\n00:01.000 --> 00:02.000\n{name}\n")
    assert {r.video_id for r in readers.captions(spark, str(tmp_path), 2).collect()} == {"video_12_a", "video_2_c"}
    assert readers.captions(spark, str(tmp_path)).count() == 3
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no WebVTT"):
        readers.captions(spark, str(tmp_path / "none"))
    (tmp_path / "z.vtt").write_text("captions\n\n00:01.000 --> 00:02.000\nx\n")
    with pytest.raises(Exception, match="not WebVTT"):
        readers.captions(spark, str(tmp_path)).collect()
    names = spark.createDataFrame([("video_12_a_b",), ("other",), (None,)], "n string")
    assert [(r.x, r.t) for r in names.select(transcript.video_number(F.col("n")).alias("x"), transcript.video_title(F.col("n")).alias("t")).collect()] == [(12, "a b"), (None, "other"), (None, None)]


def test_items_keep_all_their_fields(spark, tmp_path):
    items = [{"id": "1", "name": "n", "uses": None, "more": {"a": [1, 2]}}, {"id": 2}]
    (tmp_path / "m.json").write_text(json.dumps(items))
    rows = sorted(readers.json_documents(spark, str(tmp_path / "m.json"), ["name", "uses"]).collect(), key=lambda r: r.id)
    assert [(r.id, r.content) for r in rows] == [("1", "name: n\nuses: "), ("2", "name: \nuses: ")]
    assert [json.loads(r.metadata) for r in rows] == items


def test_plain_markdown(spark):
    rows = spark.createDataFrame([([("s", "t"), (None, None)],), ([],)], "d array<struct<source:string,text:string>>")
    got = [r.m for r in rows.select(text.documents_markdown(F.col("d"), text.PLAIN_MARKDOWN).alias("m")).collect()]
    assert got[0] == "# Retrieved Parenting Knowledge\n\n## Source 1: s\n\nt\n\n---\n\n## Source 2: Unknown\n\n\n\n---\n\n"
    assert got[1] == "No relevant information found in the knowledge base."


def test_columns_of_callers_do_no_harm(spark):
    captions = spark.createDataFrame([("v", 1, "a", "x", 9, 9, 9), ("v", 2, "b", "y", 9, 9, 9)], "k string, o int, speaker string, text string, _first int, _filled int, turn int")
    assert [(r.turn, r.speaker) for r in transcript.merge_speakers(captions, "k", "o").orderBy("turn").collect()] == [(0, "a"), (1, "b")]
    rows = spark.createDataFrame([(2, 7, 7, 7), (1, 7, 7, 7)], "o int, _part int, _i int, _before int")
    assert sorted(map(tuple, transcript.renumber(rows, ["o"]).select("o", "_part", "global_id").collect())) == [(1, 7, 0), (2, 7, 1)]
    intervals = spark.createDataFrame([("d", 2, 4, 0, 0)], "k string, start long, end long, _reach int, _last int")
    lengths = spark.createDataFrame([("d", 6, 0)], "k string, length long, _last int")
    assert sorted(tuple(r)[1:] for r in coverage.gaps(intervals, lengths, "k").collect()) == [(0, 2), (4, 6)]
    events = spark.createDataFrame([("s", 1, "token", "a", 0, 0), ("s", 2, "done", None, 0, 0)], "k string, seq int, type string, content string, _t int, _s int")
    assert sessions.accumulate(events, "k", "seq", F.col("content"), F.lit(None).cast("string")).first().answer == "a"


def test_top_k_of_each_query_limits_partitions_before_its_shuffle(spark):
    """Of whole rows only the best of each query move; null ids, ties and repeated ids are kept as they are."""
    rows = [(None if i == 7 else i // 2, "long text " * 5, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_id long, chunk_text string, embedding array<double>").repartition(4)
    queries = [[1.0, 0.0, 1.0], [0.0, 1.0, 0.5]]
    found = vector.top_k_each(df, queries, 6)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.variation, r["rank"], -1 if r.chunk_id is None else r.chunk_id, r.similarity_score) for r in found.collect())
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / sum(x * x for x in a) ** 0.5 / sum(x * x for x in b) ** 0.5, 6)
    want = []
    for v, q in enumerate(queries):
        best = sorted((-cosine(e, q), -1 if i is None else i) for i, _, e in rows)[:6]
        want += [(v, n, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want and found.columns == ["chunk_id", "chunk_text", "variation", "similarity_score", "rank"]
