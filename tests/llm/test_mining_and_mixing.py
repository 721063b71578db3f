"""Hard negatives, the audit of sources and their mix against brute force and by their invariants."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvane.llm import gif_columns, hard_negatives, language_gru, queries, source_audit, source_mix

# --- 11: hard negatives -----------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, uid int, block string, score double, bucket string, anchor_id string"


def brute_negatives(rows):
    usable = [(i, lab, tuple(math.floor(256 * float(x)) for x in v)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in usable:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        best = defaultdict(lambda: -math.inf), defaultdict(lambda: -math.inf)
        for i, other, w in usable:
            score = sum(x * y for x, y in zip(v, w, strict=False))
            if i != a and other == lab:
                best[0][i] = max(best[0][i], score)
        for p, s in sorted(best[0].items(), key=lambda x: (-x[1], x[0]))[:5]:
            found = defaultdict(lambda: -math.inf)
            for i, other, w in usable:
                n = sum(x * y for x, y in zip(v, w, strict=False))
                if other != lab and 50 * s <= 100 * n <= 95 * s:
                    found[i] = max(found[i], n)
            out += [(a, p, r + 1, i, s, n) for r, (i, n) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:3])]
    return sorted(out)


def vector_rows(n, seed, coarse):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([-0.5, 0.0, 0.25, 0.5]) if coarse else rng.gauss(0, 1) * 3.0**-k for k in range(9)]
        rows.append((i, v, 0 if rng.random() < 0.5 else rng.randrange(4)))
    rows += [(None, [1.0] * 9, 1), (7, None, 1), (8, [1.0] * 9, None), (11, [float("nan")] + [1.0] * 8, 1), (12, [None] * 9, 1), (13, [float("inf")] * 9, 0), (1001, [0.5, 0.5], 1), (1003, [], 1)]
    return rows + rows[5:9] + [(50, [0.25] * 9, 3), (50, [0.25] * 9, 3), (1050, [0.0] * 9, 2), (-50, [-0.25] * 9, 0)]


@pytest.mark.parametrize("coarse", [True, False])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, coarse):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "KEY_BLOCKS", 2)
    rows = vector_rows(300, 4, coarse)
    df = spark.createDataFrame([(*r, 1, "b", 0.0, "c", "a") for r in rows], VECTORS).repartition(3)
    got = hard_negatives.mine(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives([(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert want and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(df).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(3, [1.0], 1, 1, "b", 0.0, "c", "a")], VECTORS)).count() == 0


def test_bounds_never_lie_below_scores():
    rng = np.random.default_rng(5)
    ints = rng.integers(-4000, 4000, (64, 24))
    axes, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    empty = np.zeros((64, 0), np.int64).tobytes()
    block = hard_negatives.Block(np.arange(64).tobytes(), np.zeros(64, np.int64).tobytes(), empty, empty, ints.tobytes(), axes, [1, 6, 23])
    scores = ints @ ints.T
    for bound in block.bounds:
        assert (bound @ bound.T >= scores).all()
    i, j = np.nonzero(scores > 0)
    assert (hard_negatives.products(ints, ints, i, j) == scores[i, j]).all()


def test_scores_beyond_long_are_an_error(spark):
    rows = [(0, [1e15] * 3, 1), (1, [1e15] * 3, 1)]
    df = spark.createDataFrame([(i, v, lab) for i, v, lab in rows], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="2\\^55"):
        hard_negatives.mine(df).collect()


# --- 12: audit of sources ---------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, min_docs):
    groups, n, df = set(), Counter(), Counter()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall(text.translate(LOWER))
        groups.add((lang, source))
        n.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = [t for (x, t), c in df.items() if x == lang and c >= min_docs]
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (n[lang, s, t] + 2) // (total[s] + 2 * len(kept)) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(n[lang, s, t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s, t], p[o, t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s, t], q[t]), t.encode(), t) for t in kept if n[lang, s, t] and p[s, t] > q[t])[:10]
            out += [(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(terms)]
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 2, 100])
def test_audit_equals_brute_force(docs, min_docs):
    got = source_audit.audit(docs, min_docs=min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit([(r.text, r.lang, r.source) for r in docs.collect()], min_docs)


def test_audit_of_many_sources(spark):
    rng = random.Random(9)
    words = ["Über", "ÜBER", "straße", "a", "A", "bb", "中文", "x1y", "I", "İ", "zz-top", "é", "\U0001f600", "C", "c", "d", "e", "f", "g"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))) + rng.choice(["", "\n", "\x00", "_"]), rng.choice(["en", "de", None, ""]), rng.choice(["s", "S", "é", None, "~", "中", "a"])) for _ in range(300)]
    rows += [("only one source", "xx", "s"), (None, "yy", None), (None, "yy", "t")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, source_audit.audit(df).collect())) == brute_audit(rows, 10)


def test_audit_of_nothing(none):
    assert source_audit.audit(none).count() == 0


def test_shares_of_large_counts(spark):
    for n, total, v in [(0, 0, 1), (7, 10, 3), (3 * 10**12, 10**13, 10**6), (2 * 10**14, 2 * 10**14, 5)]:
        got = spark.sql(f"SELECT {source_audit.share(f'{n}L', f'{total}L', f'{v}L')} AS p").first().p
        assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


# --- 13: mixing -------------------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """The targets by capping one source after another, in exact fractions."""
    totals = defaultdict(int)
    for source, size in sizes:
        totals[source] += size
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, budget, target = set(order), Fraction(3 * sum(totals.values()), 2), {}
    while left:
        each = budget / sum(weight[s] for s in left)
        over = {s for s in left if each * weight[s] > 2 * totals[s]}
        if not over:
            target |= {s: each * weight[s] for s in left}
            break
        for s in over:
            target[s] = Fraction(2 * totals[s])
            budget -= target[s]
        left -= over
    return {s: float(x) for s, x in target.items()}, totals


def corpus(seed, n, hot=0.4):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 2, 10, 100, 100, 1000]) if rng.random() < 0.9 else rng.randrange(20_000) for _ in range(n)]
    return [(i, "w " * k, "hot" if rng.random() < hot else rng.choice(["a", "b", None, "", "é", "Z"])) for i, k in enumerate(sizes)]


def check_mix(rows, got):
    sizes = [(s, len(WORDS.findall(t or ""))) for _, t, s in rows]
    targets, totals = brute_targets(sizes)
    by_id = Counter((i, size) for (i, _, _), (_, size) in zip(rows, sizes, strict=True))
    assert Counter((r.doc_id, r.size) for r in got) == by_id
    source_of = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == totals[s] and math.isclose(r.target, targets[s], rel_tol=1e-12, abs_tol=1e-9)
        assert r.taken in {0, r.size, 2 * r.size}
        ratio = r.target / r.source_size if r.source_size else 0
        assert math.floor(ratio + 1e-12) * r.size <= r.taken <= math.ceil(ratio - 1e-12) * r.size or not r.size
        taken[s] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(size for x, size in sizes if x == s) + 1e-6


@pytest.mark.parametrize("group", [4096, 8])
def test_mix_meets_its_targets(spark, monkeypatch, group):
    monkeypatch.setattr(source_mix, "GROUP_DOCS", group)
    monkeypatch.setattr(source_mix, "FAN_BITS", 2)
    rows = corpus(3, 900)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix(df.repartition(5)).collect()
    check_mix(rows, got)
    again = source_mix.mix(df.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_with_sources_beside_the_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "HOT", 3)  # only a third of all rows makes a source hot
    rows = corpus(5, 400)
    check_mix(rows, source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_mix_of_awkward_rows(docs, none, spark):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check_mix(rows, source_mix.mix(docs).collect())
    assert source_mix.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.source_size, r.target, r.taken) for r in source_mix.mix(blank).collect()] == [(0, 0, 0.0, 0)] * 2


def test_expectations_stay():
    rng = random.Random(1)
    sums, n = [0.0, 0.0], 40_000
    for _ in range(n):
        a, b = source_mix.fight(3.0, 10.0, 20.0, 40.0, rng.random())
        assert a + b == pytest.approx(23) and (a in (0, 10) or b in (0, 40)) and 0 <= a <= 10 and 0 <= b <= 40
        sums = [sums[0] + a, sums[1] + b]
    assert sums[0] / n == pytest.approx(3, abs=0.15) and sums[1] / n == pytest.approx(20, abs=0.15)


def test_copies_are_as_probable_as_they_should(spark):
    """Over many corpora of one shape, every document is taken about as often as its source asks for."""
    taken, runs = Counter(), 60
    rows = [(run * 100 + k, "w " * (1 + 7 * k), f"{run:03d}") for run in range(runs) for k in range(20)]
    got = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = Counter()
    for r in got:
        taken[r.doc_id % 100 // 5] += r.taken / r.size
        want[r.doc_id % 100 // 5] += r.target / r.source_size
    for k in want:
        assert abs(taken[k] - want[k]) < 5 * math.sqrt(runs * 5 / 4)


def test_word_count(spark):
    texts = ["", None, " ", "a", " a", "a ", " a  b\n", "\x0b\x0ca\x1cb c d\x00", "\r\n\t"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(source_mix.word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [len(WORDS.findall(t or "")) for t in texts]


def test_mix_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check_mix([(r.doc_id, r.text, r.source) for r in docs], queries.op13_source_mix(spark, sf).collect())


# --- 3: null and damaged media ----------------------------------------------------------------------------------------


def lzw_reader(data: bytes) -> tuple[list[bytes], int]:
    """Pixels of the frames of a GIF by another reader: whole strings in the table, codes from one large number."""
    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 128 else 0)
    out, total, size = [], 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                total += int.from_bytes(data[at + 4 : at + 6], "little")
            at += 2
        else:
            w, h, flags = (*(int.from_bytes(data[at + k : at + k + 2], "little") for k in (5, 7)), data[at + 9])
            at += 10 + (3 << (flags & 7) + 1 if flags & 128 else 0)
            size, at = data[at], at + 1
        blocks = b""
        while data[at]:
            blocks += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        if size is not None:
            stream, bits = int.from_bytes(blocks, "little"), 0
            clear, width, table, last, pixels = 1 << size, size + 1, [], None, b""
            while True:
                code = stream >> bits & (1 << width) - 1
                bits += width
                if code == clear:
                    table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
                    continue
                if code == clear + 1:
                    break
                entry = table[code] if code < len(table) else last + last[:1]
                if last is not None and len(table) < 4096:
                    table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
                pixels, last = pixels + entry, entry
            assert len(pixels) == w * h
            out.append(pixels)
            size = None
    return out, total


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 9216, 9217, 40_000])
def test_another_reader_reads_what_is_stored(n):
    rng = random.Random(n)
    text = "".join(rng.choice("abc é\n") for _ in range(n)).encode()[:n].decode(errors="ignore")
    size, payload = gif_columns.padded(text)
    pixels, _ = lzw_reader(gif_columns.store_bytes(payload))
    assert size == len(text.encode()) and b"".join(pixels)[: len(payload)] == payload


def test_null_and_damaged_media(spark, docs, none):
    good = gif_columns.store_bytes(gif_columns.padded("text")[1])
    rows = [(1, 4, good), (2, 0, None), (3, 0, b""), (4, 0, b"GIF89a"), (5, 4, good[: len(good) // 2]), (1, 4, good)]
    got = sorted(gif_columns.media_digests(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect(), key=lambda r: r.doc_id)
    assert got[0] == got[1] and got[0].payload_bytes == 576 and got[0].media_bytes == len(good)
    assert [x for r in got[2:3] for x in r[2:]] == [None] * 6
    for r in got[3:]:
        assert r.payload_bytes is r.payload_sha256 is r.tail_crc32 is r.feature is None and r.media_sha256
    stored = gif_columns.store_texts(docs)
    assert {r.doc_id: r.n_bytes for r in stored.collect()}[14] == 50_000 and stored.count() == docs.count()
    assert gif_columns.media_digests(gif_columns.store_texts(none)).count() == 0


# --- 4: the recurrent network byte by byte ----------------------------------------------------------------------------


def loop_probabilities(net, text: bytes) -> np.ndarray:
    """The mean over bytes of the labels' probabilities, one byte and one direction at a time."""
    size, total = language_gru.HIDDEN, np.zeros(len(net.languages))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for a in range(0, len(text), language_gru.WINDOW):
        window, states = text[a : a + language_gru.WINDOW], []
        for d, order in ((0, range(len(window))), (1, range(len(window) - 1, -1, -1))):
            h, found = np.zeros(size), {}
            for t in order:
                given, past = net.inputs[d][window[t]].astype(float), h @ net.hidden[d].astype(float)
                z, r = sigmoid(given[:size] + past[:size]), sigmoid(given[size : 2 * size] + past[size : 2 * size])
                n = np.tanh(given[2 * size :] + r * past[2 * size :])
                h = n + z * (h - n)
                found[t] = h
            states.append(found)
        for t in range(len(window)):
            logits = np.concatenate([states[0][t], states[1][t]]) @ net.out.astype(float) + net.bias
            e = np.exp(logits - logits.max())
            total += e / e.sum()
    return total / max(1, len(text))


def test_the_network_equals_a_loop_over_bytes():
    rng = np.random.default_rng(2)
    net = language_gru.Network.start(["de", "en", "fr"], 1)
    for w in net.weights:
        w += rng.normal(0, 0.4, w.shape).astype(w.dtype)
    texts = [b"", b"a", "Grüße \U0001f600".encode(), bytes(rng.integers(0, 256, language_gru.WINDOW)), bytes(rng.integers(0, 256, 2 * language_gru.WINDOW + 7))]
    got = language_gru.document_probabilities(net, texts)
    for text, p in zip(texts, got, strict=True):
        assert np.allclose(p, loop_probabilities(net, text), atol=2e-4)


def test_the_fast_forward_pass_equals_the_one_that_trains():
    rng = np.random.default_rng(3)
    net = language_gru.Network.start(["de", "en"], 1)
    x = rng.integers(0, 256, (5, 40)).astype(np.uint8)
    valid = np.arange(40) < np.array([40, 1, 17, 39, 0])[:, None]
    assert np.allclose(language_gru._states(net, x, valid), language_gru.forward(net, x, valid)[0], atol=1e-5)
