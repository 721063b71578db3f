"""Secret scan by ownership frequency over the whole corpus.

Every text gives base spans (assignments, access keys, long hex) and candidates: other long tokens that look random. The
hash of each value is aggregated over the distinct repositories and owners that hold it:

* ``example``: EXAMPLE_OWNERS owners or more, or COPIED_REPOSITORIES repositories or more of fewer owners (two at least):
  widely copied.
* ``live``: one owner in LIVE_REPOSITORIES repositories at most: a credential of theirs.
* ``shared``: all else, as a value that one owner has everywhere (a template of their own) or that two owners share.

Live candidates become spans of kind ``owner`` beside the base spans; others stay candidates.

Texts are read once; what is shuffled are hashes and positions. A value that a third of all rows hold is combined before
its shuffle to one row for each repository and owner. Nulls and ties: null text is empty; a null repository or owner
counts as one of its own, apart from the empty name; rows that repeat are judged alike; empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let_go, materialise, small_batches, spread_join

# Fixed values of the base.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "owner")

#: Candidates: tokens of this many characters, with letters and digits, and at least so many bits a character.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
BITS = 3.0
EXAMPLE_OWNERS, COPIED_REPOSITORIES, LIVE_REPOSITORIES = 3, 6, 3
NO_ID = -(2**63)


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in order; kind is a place in KINDS."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidate_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking tokens that no base span touches."""
    found = []
    for m in CANDIDATE.finditer(text):
        token = m[0]
        mixed = any(c.isdigit() for c in token) and any(c.isalpha() for c in token)
        if mixed and entropy(token) >= BITS and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            found.append((m.start(), 3, m.end(), token))
    return found


def _halves(value: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(value.encode())
    return ((h >> 64) ^ 2**63) - 2**63, ((h & (2**64 - 1)) ^ 2**63) - 2**63


def _listed(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b, _ in spans)


_FOUND = "array<struct<start:long,kind:int,end:long,h1:long,h2:long>>"


def scan(docs: DataFrame, text_col: str, id_col: str, repository: Column, owner: Column) -> DataFrame:
    """A row for each document, without its text: counts, the digest of the base spans, and all values' hashes."""
    found = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]))
    schema = pa.schema([
        ("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("repository", pa.string()), ("owner", pa.string()),
        ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("found", found),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            rows = []
            for text in batch.column(5).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = base + candidate_spans(text, base)
                n = Counter(kind for _, kind, _, _ in base)
                hashes = [dict(zip(("start", "kind", "end", "h1", "h2"), (a, kind, b, *_halves(v)), strict=True)) for a, kind, b, v in spans]
                rows.append((n[0], n[1], n[2], hashlib.sha256(_listed(base).encode()).hexdigest(), hashes))
            made = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(c, f.type) for c, f in zip(made, list(schema)[5:], strict=True)]], schema=schema)

    text = F.col(f"`{text_col}`")
    rows = small_batches(docs).select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), text.alias("text"),
    )
    return rows.mapInArrow(
        run, f"uid long, doc_id long, text_hash long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found {_FOUND}"
    )


def ownership(values: DataFrame) -> DataFrame:
    """(h1, h2, n_repositories, n_owners, n_seen, class) from (h1, h2, repository, owner), a row for each occurrence."""
    held = values.groupBy("h1", "h2", "repository", "owner").agg(F.count("*").alias("n"))  # combined before the shuffle
    name = lambda c: F.struct(F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))
    owners, repositories = F.col("n_owners"), F.col("n_repositories")
    copied = (owners >= EXAMPLE_OWNERS) | ((owners > 1) & (repositories >= COPIED_REPOSITORIES))
    live = (owners == 1) & (repositories <= LIVE_REPOSITORIES)
    counts = held.groupBy("h1", "h2").agg(
        F.count_distinct(name("repository")).alias("n_repositories"), F.count_distinct(name("owner")).alias("n_owners"), F.sum("n").alias("n_seen")
    )
    return counts.withColumn("class", F.when(copied, "example").when(live, "live").otherwise("shared"))


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """A row for each document: uid, doc_id, text_hash, base counts and digest, all spans, and its live and example values.

    ``secrets`` holds (start, kind, end, class) of the base spans and the live candidates. Owner is the column
    ``source`` unless given, a repository the pair of ``source`` and ``lang``.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    seen = materialise(scan(docs, text_col, id_col, repository, owner), "secrets")
    values = seen.select("uid", "repository", "owner", F.inline("found"))
    classed = materialise(ownership(values), "ownership")
    judged = spread_join(values, classed, ["h1", "h2"], "n_seen", ["uid", "start"]).where((F.col("kind") < 3) | (F.col("class") == "live"))
    by_doc = judged.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "class"))).alias("secrets"),
        F.count_if(F.col("class") == "live").alias("n_live"), F.count_if(F.col("class") == "example").alias("n_example"),
    )
    kinds = F.array(*map(F.lit, KINDS))
    listed = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    return seen.join(by_doc, "uid", "left").select(
        "uid", "doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(listed, F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"), "secrets",
    )


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """``docs`` with every secret but widely copied examples replaced by ``<kind>``; no row is dropped.

    A null text stays null.
    """
    found = find_secrets(docs, text_col, id_col, repository, owner)
    key, h, cut = (fresh(docs, c) for c in ("_id", "_hash", "_cut"))
    cuts = (
        found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key), F.col("text_hash").alias(h), F.filter("secrets", lambda s: s["class"] != "example").alias(cut))
        .where(F.size(cut) > 0)
        .withColumn(cut, F.array_join(F.transform(cut, lambda s: F.concat_ws(":", s["start"], s["end"], s["kind"])), ","))
        .groupBy(key, h)
        .agg(F.max(cut).alias(cut))
    )

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, where in zip(texts, cuts, strict=True):
            if text and where:
                parts, at = [], 0
                for a, b, kind in (map(int, x.split(":")) for x in where.split(",")):
                    if b > at:  # spans may overlap: what is left of one belongs to the span before
                        if a >= at:
                            parts += [text[at:a], f"<{KINDS[kind]}>"]
                        at = b
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    return (
        docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)))
        .withColumn(h, F.xxhash64(F.col(f"`{text_col}`")))
        .join(cuts, [key, h], "left")
        .withColumn(text_col, without(F.col(f"`{text_col}`"), F.col(cut)))
        .drop(key, h, cut)
    )
