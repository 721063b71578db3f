"""Token ids as files of a static range asymmetric numeral system (rANS).

A file holds the ids of consecutive documents. One frequency table, counted over all ids of the file, is shared by its
blocks. A block is a fixed run of ids dealt over interleaved lanes, each with a state of its own, so that all lanes of
all blocks are coded by the same numpy steps. Blocks are independent: the table of checkpoints has the place of each
block's words, its lanes' states and the checksum of its ids, so any block can be decoded alone.

Documents are sorted by one range shuffle; files and their ids are in ascending order of doc_id. A file is a row of a
Parquet table, since that is what Spark writes to any store and commits even if executors are lost.

Nulls and ties: a null text is the empty one and has the end id alone; a null doc_id comes first; rows of one doc_id
are in the order of their texts' hashes. An empty table gives no file and no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import encoder, joined

MAGIC = b"KVRANS01"
FILE_IDS = 1 << 20  # a file ends with the document that reaches this many
LANES, STEPS = 32, 512
BLOCK = LANES * STEPS
SCALE = 20  # frequencies of a table add up to 2^SCALE
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
NO_ID = -(2**63)


class Corrupt(ValueError):
    """A checksum of a file or block does not fit."""


def frequencies(counts: np.ndarray) -> np.ndarray:
    """``counts`` scaled to a sum of 2^SCALE, none below 1."""
    total = 1 << SCALE
    scaled = np.maximum(1, counts.astype(np.float64) * total / counts.sum()).astype(np.int64)
    over = int(scaled.sum()) - total
    order = np.argsort(-scaled)
    while over > 0:  # rounding up the rare ones is paid by the frequent ones
        take = np.minimum(scaled[order] - 1, np.maximum(1, scaled[order] * over // total))
        take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
        scaled[order] -= take
        over = int(scaled.sum()) - total
    scaled[order[0]] -= over
    return scaled


def encode_blocks(places: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, their number by block, and the lanes' states, of places in the table, whole blocks of them."""
    cum = np.cumsum(freq) - freq
    rows = places.reshape(-1, STEPS, LANES).transpose(1, 0, 2)  # step, block, lane
    f_all, c_all = freq.astype(np.uint64)[rows], cum.astype(np.uint64)[rows]
    state = np.full(rows.shape[1:], LOW, np.uint64)
    out, given = np.zeros(rows.shape, np.uint32), np.zeros(rows.shape, bool)
    for step in range(STEPS - 1, -1, -1):
        f = f_all[step]
        full = state >= f << np.uint64(63 - SCALE)
        given[step], out[step] = full, state.astype(np.uint32)
        state = np.where(full, state >> WORD, state)
        whole = state // f
        state = (whole << np.uint64(SCALE)) + (state - whole * f) + c_all[step]
    given = given.transpose(1, 0, 2)
    return out.transpose(1, 0, 2)[given], given.sum(axis=(1, 2)), state


def decode_blocks(words: np.ndarray, starts: np.ndarray, states: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Places in the table, by block; ``starts`` are the blocks' first words."""
    cum = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    freq, cum = freq.astype(np.uint64), cum.astype(np.uint64)
    state, at = states.copy(), starts.astype(np.int64).copy()
    out = np.empty((len(starts), STEPS, LANES), np.int32)
    words = np.concatenate([words, np.zeros(1, np.uint32)]).astype(np.uint64)
    low = np.uint64((1 << SCALE) - 1)
    for step in range(STEPS):
        slot = state & low
        place = slots[slot.astype(np.int64)]
        out[:, step] = place
        state = freq[place] * (state >> np.uint64(SCALE)) + slot - cum[place]
        empty = state < LOW
        turn = np.cumsum(empty, axis=1)
        word = words[np.where(empty, at[:, None] + turn - 1, len(words) - 1)]
        state = np.where(empty, (state << WORD) | word, state)
        at += turn[:, -1]
    return out.reshape(len(starts), BLOCK)


def to_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file. Head: six sizes; then the documents, the table, the checkpoints, the words, a checksum."""
    seen = np.bincount(ids)
    symbols = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[symbols] = np.arange(len(symbols))
    freq = frequencies(seen[symbols])
    padded = np.full(-(-len(ids) // BLOCK) * BLOCK, int(np.argmax(freq)), np.int64)
    padded[: len(ids)] = place[ids]
    words, sizes, states = encode_blocks(padded, freq)
    checks = [zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)]
    docs = zlib.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + lengths.astype("<u4").tobytes(), 1)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    head = np.array([len(doc_ids), len(ids), len(symbols), len(docs), len(table), len(words)], "<u8").tobytes()
    points = np.cumsum(sizes).astype("<u8").tobytes() + states.astype("<u8").tobytes() + np.array(checks, "<u4").tobytes()
    body = b"".join([MAGIC, head, docs, table, points, words.astype("<u4").tobytes()])
    return body + zlib.crc32(body).to_bytes(4, "little")


class IdFile:
    """A file's documents at once, its ids by block."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != int.from_bytes(data[-4:], "little"):
            raise Corrupt("not a file of ids, or damaged")
        n_docs, self.n_ids, n_symbols, docs, table, n_words = np.frombuffer(data, "<u8", 6, 8).astype(np.int64).tolist()
        at = 56
        raw = zlib.decompress(data[at : at + docs])
        with np.errstate(over="ignore"):
            self.doc_ids = np.cumsum(np.frombuffer(raw, "<i8", n_docs))
        self.lengths = np.frombuffer(raw, "<u4", n_docs, 8 * n_docs).astype(np.int64)
        at += docs
        raw = zlib.decompress(data[at : at + table])
        self.symbols = np.cumsum(np.frombuffer(raw, "<u4", n_symbols)).astype("<u4")
        self.freq = np.frombuffer(raw, "<u4", n_symbols, 4 * n_symbols).astype(np.int64)
        at += table
        self.n_blocks = -(-self.n_ids // BLOCK)
        self.ends = np.frombuffer(data, "<u8", self.n_blocks, at).astype(np.int64)
        at += 8 * self.n_blocks
        self.states = np.frombuffer(data, "<u8", self.n_blocks * LANES, at).reshape(-1, LANES)
        at += 8 * self.n_blocks * LANES
        self.checks = np.frombuffer(data, "<u4", self.n_blocks, at)
        self.words = np.frombuffer(data, "<u4", n_words, at + 4 * self.n_blocks)

    def blocks(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of some of the blocks, each checked."""
        last = self.n_blocks if last is None else last
        starts = np.concatenate([[0], self.ends])[first:last]
        ids = self.symbols[decode_blocks(self.words, starts, self.states[first:last], self.freq)].reshape(-1)
        ids = ids[: self.n_ids - first * BLOCK]
        for k, block in enumerate(range(first, last)):
            if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes()) != self.checks[block]:
                raise Corrupt(f"block {block}")
        return ids


def write_ids(docs: DataFrame, path: str, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", end_id: int = 0) -> None:
    """Write the ids of all texts under ``path``, one file a row: part, chunk, first_id (in its part), n_ids, data."""
    fields = [("part", pa.int64()), ("chunk", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]
    schema = pa.schema(fields)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, first = TaskContext.get().partitionId(), 0, 0
        encode = encoder(tokenizer, True).encode
        doc_ids, texts_ids, n = [], [], 0

        def file() -> pa.RecordBatch:
            data = to_file(np.array(doc_ids, np.int64), np.array([len(x) // 4 for x in texts_ids]), np.frombuffer(b"".join(texts_ids), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, chunk, first, n, data), schema, strict=True)], schema=schema)

        for batch in joined(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                texts_ids.append(ids + end)
                n += len(ids) // 4 + 1
                if n >= FILE_IDS:
                    yield file()
                    chunk, first = chunk + 1, first + n
                    doc_ids, texts_ids, n = [], [], 0
        if n:
            yield file()

    rows = small_batches(docs).select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(run, "part long, chunk long, first_id long, n_ids long, data binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """From the files alone: doc_id, start, n_tokens, ids_crc32, and the ids if wanted."""
    files = spark.read.schema("part long, chunk long, first_id long, n_ids long, data binary").parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = IdFile(batch.column(1)[i].as_py())
                ids = file.blocks()
                cuts = np.concatenate([[0], np.cumsum(file.lengths)])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                columns = [pa.array(file.doc_ids, mask=file.doc_ids == NO_ID), pa.array(batch.column(0)[i].as_py() + cuts[:-1]), pa.array(file.lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    placed = files.join(before, "part").select((F.col("before") + F.col("first_id")).alias("start"), "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
