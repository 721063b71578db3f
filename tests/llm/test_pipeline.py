"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

import pathlib
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from korvane.llm import quality_rules
from korvane.llm.common import materialise, shared_dir

from .test_operators import brute_classes, judged, redacted


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output of each stage, as (doc_id -> text)."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf), name)
        out[name] = before, docs
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "secret_scan", "packing"]
    for name in list(stages)[:-1]:
        assert tuple(stages[name][1].columns) == corpus_pipeline.COLUMNS


def test_quality(stages):
    before, after = stages["quality_rules"]
    m = {r.doc_id: r for r in quality_rules.metrics(before).collect()}
    ok = {i for i, r in m.items() if not (r.n_words < 10 or r.n_repeat_words * 100 > r.n_words * 20 or r.n_symbols * 10 > r.n_words * 3
          or r.word_chars < r.n_words * 2 or r.word_chars > r.n_words * 16 or r.n_dup_lines * 100 > r.n_lines * 30)}
    space = " \t\n\x0b\x0c\r"

    def own(text):
        words = [w for w in re.split(f"[{space}]+", text or "") if w]
        lines = [x.rstrip(space) for x in (text or "").split("\n") if x.strip(space)]
        few = 100 * sum(any(c.isalpha() for c in w) for w in words) < 60 * len(words)
        return few or (len(words) >= 30 and len(set(words)) < 10) or 100 * sum(x.endswith(("...", "…")) for x in lines) > 30 * len(lines)

    ok -= {i for i, t in texts(before).items() if own(t)}
    assert set(texts(after)) == ok


def test_lines(stages):
    before, after = map(texts, stages["line_dedup"])
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in before.items():
        for k in {key(x) for x in t.split("\n")}:
            holders.setdefault(k, set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    assert after == {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in before.items()}


def test_near_duplicates(stages):
    before, after = map(texts, stages["near_duplicates"])
    assert set(after) == set(brute_classes(before).values())


def test_secrets(stages):
    before, after = stages["secret_scan"]
    docs = {r.doc_id: (r.text, r.source, f"{r.source}/{r.lang}" if r.lang else r.source) for r in before.collect()}
    _, classed = judged(docs)
    want = {i: redacted(text, classed[i]) for i, (text, _, _) in docs.items()}
    assert texts(after) == want


def test_packing(stages):
    before, rows = texts(stages["packing"][0]), stages["packing"][1].collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for r in sorted(rows, key=lambda r: r.start):
        ids.setdefault(r.doc_id, []).extend(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert ids == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in before.items()}


def test_a_run_leaves_the_tables_of_its_stages_alone(spark, tmp_path):
    rows = [(i, f"document {i} of a few that say something of their own, number {i * i} and so on for a while", "en", "s", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    folder = pathlib.Path(shared_dir(spark)) / "korvane" / spark.sparkContext.applicationId
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    made = sorted(p.name.rpartition("-")[0] for p in folder.iterdir() if p.name not in before)
    assert made == ["line_dedup", "near_duplicates", "pieces", "quality_rules", "secret_scan"]
