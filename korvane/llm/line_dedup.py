"""Line dedup: repeated lines go through a sharded minimal perfect hash instead of a join of lines.

1. Every document gives the distinct 128-bit hashes of its long lines. One aggregation (with map-side combine) counts
   documents and keeps the largest doc_id; only hashes in ``min_docs`` documents or more go on.
2. Their hashes are split into shards of a few thousand. One task makes of each a minimal perfect hash and three plain
   arrays: fingerprint, count, largest doc_id.
3. The documents' hashes are dealt out to the shards and stream past the arrays of one shard at a time. A shard
   that gets more rows than one task should read is dealt out over several tasks, each with a copy of its arrays.
4. The hashes to drop, grouped by document, go back to the texts.

Nulls and ties: a null or empty text is one empty line; a null doc_id ranks below all others; rows that share the
largest doc_id of a line all keep it. Empty tables stay empty, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import fresh, let_go, materialise, small_batches

MIN_CHARS, MIN_DOCS = 20, 3
#: Distinct hashes in a shard, and the rows that one task should read at most; both only steer the cost.
KEYS_PER_SHARD, ROWS_PER_TASK = 8192, 100_000
NO_ID = -(2**63)


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """For each line its key, or None if that is too short. ASCII letters only are lower-cased."""
    keys = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        line = line.strip(b" \t\n\x0b\x0c\r")
        long = len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode("utf-8", "surrogatepass")) >= min_chars)
        keys.append(line if long else None)
    return keys


def hashed(key: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    h = xxhash.xxh3_128_intdigest(key)
    return ((h >> 64) ^ 2**63) - 2**63, ((h & (2**64 - 1)) ^ 2**63) - 2**63


# --- the minimal perfect hash -----------------------------------------------------------------------------------------


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Levels of bit arrays: a hash that is alone at its place of a level is set there, the others go to the next.

    The rank of the set bit is a minimal perfect hash. ``keys`` must be distinct unsigned 64-bit hashes.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        self.ranks = np.cumsum(flat) - 1
        self.starts = np.cumsum([0, *map(len, levels)])

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 1.5) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            at = (_mix(rest, len(levels)) % np.uint64(max(1, int(len(rest) * load)))).astype(np.int64)
            alone = np.bincount(at, minlength=max(1, int(len(rest) * load))) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for one that no level has (others get the place of some member)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[self.starts[level] + at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return head + np.packbits(np.concatenate(self.levels) if self.levels else np.zeros(0, bool)).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * (n + 1)))[: int(sizes.sum())].astype(bool)
        return cls(np.split(bits, np.cumsum(sizes)[:-1]) if n else [])


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard: its perfect hash, fingerprints, counts and largest ids, in the order of the hash."""
    keys = pdf["h1"].to_numpy(np.int64).view(np.uint64)
    first = ~pd.Series(keys).duplicated().to_numpy()  # two lines that share 64 bits: the second goes to the overflow list
    perfect = PerfectHash.build(keys[first])
    order = np.argsort(perfect.index(keys[first]))
    main = pdf[first].iloc[order]
    table = pd.concat([main, pdf[~first]])
    return pd.DataFrame({
        "shard": [pdf["shard"].iloc[0]],
        "salts": [pdf["salts"].iloc[0]],
        "hash": [perfect.to_bytes()],
        "prints": [table["h2"].to_numpy("<i8").tobytes()],
        "counts": [table["n_docs"].to_numpy("<i8").tobytes()],
        "largest": [table["largest"].to_numpy("<i8").tobytes()],
        "extra": [pdf.loc[~first, "h1"].to_numpy("<i8").tobytes()],
    })


class Shard:
    def __init__(self, hash: bytes, prints: bytes, largest: bytes, extra: bytes):
        self.hash = PerfectHash.from_bytes(hash)
        self.prints, self.largest = np.frombuffer(prints, "<i8"), np.frombuffer(largest, "<i8")
        self.extra = np.frombuffer(extra, "<i8")

    def drops(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """True where the line is indexed and another document is the one that keeps it."""
        at = self.hash.index(h1.view(np.uint64))
        found = at >= 0
        at = np.where(found, at, 0)
        out = found & (self.prints[at] == h2) & (self.largest[at] != ids)
        for k, key in enumerate(self.extra, len(self.prints) - len(self.extra)):
            out |= (h1 == key) & (self.prints[k] == h2) & (self.largest[k] != ids)
        return out


# --- the Spark job ----------------------------------------------------------------------------------------------------


def distinct_keys(docs: DataFrame, text_col: str, id_col: str, min_chars: int) -> DataFrame:
    """(id, h1, h2), once for each document and long line."""
    schema = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            ids, one, two = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for h1, h2 in {hashed(k) for k in set(line_keys(text, min_chars)) if k is not None}:
                    ids.append(doc_id)
                    one.append(h1)
                    two.append(h2)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, one, two)], schema=schema)

    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id long, h1 long, h2 long")


def line_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The shards of the index over all lines in ``min_docs`` documents or more."""
    seen = Observation()
    repeated = materialise(
        distinct_keys(docs, text_col, id_col, min_chars)
        .distinct()  # rows of one id are one document
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("id").alias("largest"))
        .observe(seen, F.coalesce(F.sum("n_docs"), F.lit(0)).alias("rows"))
        .where(F.col("n_docs") >= min_docs),
        "lines",
    )
    n_shards = max(1, -(-repeated.count() // KEYS_PER_SHARD))
    spread = seen.get["rows"] // n_shards  # the rows that every shard gets anyway
    sharded = repeated.withColumn("shard", F.pmod(F.xxhash64("h1"), F.lit(n_shards)).cast("long"))
    weight = sharded.groupBy("shard").agg(F.ceil((F.sum("n_docs") + spread) / ROWS_PER_TASK).alias("salts"))
    shards = sharded.join(weight, "shard").groupBy("shard").applyInPandas(
        build_shard, "shard long, salts long, hash binary, prints binary, counts binary, largest binary, extra binary"
    )
    return materialise(shards.withColumn("n_shards", F.lit(n_shards)), "shards")


def lines_to_drop(docs: DataFrame, index: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, drops): for each document that loses lines, the first halves of their hashes."""
    found = index.select(F.max("n_shards")).first()[0]  # one number
    keys = distinct_keys(docs, text_col, id_col, min_chars)
    probes = (
        keys.withColumn("shard", F.pmod(F.xxhash64("h1"), F.lit(found or 1)).cast("long"))
        .join(index.select("shard", "salts"), "shard")
        .select("shard", F.pmod(F.xxhash64("id", "h1"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "id", "h1", "h2",
                *[F.lit(None).cast("binary").alias(c) for c in ("hash", "prints", "largest", "extra")])
    )
    arrays = index.select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"),
        *[F.lit(None).cast("long").alias(c) for c in ("id", "h1", "h2")], "hash", "prints", "largest", "extra",
    )
    schema = pa.schema([("id", pa.int64()), ("h1", pa.int64())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            cuts = [*np.flatnonzero(kind == 0).tolist(), len(kind)]
            keep = [np.zeros(0, np.int64)]
            ids, h1, h2 = (batch.column(c).fill_null(0).to_numpy() for c in ("id", "h1", "h2"))

            def against(a: int, b: int, shard=None, keep=keep, ids=ids, h1=h1, h2=h2) -> None:
                if a < b:
                    keep.append(a + np.flatnonzero(shard.drops(h1[a:b], h2[a:b], ids[a:b])))

            against(0, cuts[0], shard)
            for a, b in zip(cuts, cuts[1:], strict=False):
                shard = Shard(*(batch.column(c)[a].as_py() for c in ("hash", "prints", "largest", "extra")))
                against(a + 1, b, shard)
            at = np.concatenate(keep)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(h1[at])], schema=schema)

    hits = (
        arrays.unionByName(probes)
        .repartition("shard", "salt")
        .sortWithinPartitions("shard", "salt", "kind")
        .mapInArrow(probe, "id long, h1 long")
    )
    return hits.groupBy("id").agg(F.collect_list("h1").alias("drops"))


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with shortened texts, and n_lines and n_dropped, which replace columns of those names.

    A null text stays one empty line and becomes the empty text.
    """
    index = line_index(small_batches(docs), text_col, id_col, min_chars, min_docs)
    drops = lines_to_drop(docs, index, text_col, id_col, min_chars)

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def shorten(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, drops, strict=True):
            lines = (text or "").split("\n")
            kept = lines
            if gone is not None:
                gone = set(gone.tolist())
                kept = [x for x, key in zip(lines, line_keys(text, min_chars), strict=True) if key is None or hashed(key)[0] not in gone]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    key, gone, made = (fresh(docs, c) for c in ("_id", "_drops", "_made"))
    return (
        docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)))
        .join(drops.select(F.col("id").alias(key), F.col("drops").alias(gone)), key, "left")
        .withColumn(made, shorten(F.col(f"`{text_col}`"), F.col(gone)))
        .withColumn(text_col, F.col(f"{made}.text"))
        .withColumn("n_lines", F.col(f"{made}.n_lines"))
        .withColumn("n_dropped", F.col(f"{made}.n_dropped"))
        .drop(key, gone, made)
    )
