"""Packing by powers of two: every document is split into pieces whose lengths are powers of two.

A document of n ids becomes as many whole sequences as fit, and one piece for each set bit of the rest, so that no
sequence holds two documents and none is padded. Pieces of one length form a bucket; sequences are numbered through
the buckets, from the longest, and within a bucket through parts of the corpus by a hash of doc_id, in each of them in the
order of doc_id.

Nulls and ties: a null text is the empty one and gives the end id alone. A null doc_id is a value like others, the first of
its part. Rows that repeat are packed each. An empty table gives none; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .tokens import encoder

MAX_LENGTH, END_ID = 4096, 2
#: Numbering runs in independent parts of the corpus for each bucket: at least so many, and about so many pieces in one.
PARTS, PART_PIECES = 1024, 1 << 20


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """The powers of two that n is the sum of, none above ``longest`` (a power of two), the longest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def piece_rows(docs: DataFrame, tokenizer: str, text_col: str, id_col: str, longest: int, end_id: int, with_ids: bool) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and its ids if wanted."""
    fields = [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, False).encode_column
        for batch in batches:
            rows, all_ids = [], []
            ids, cuts = encode(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), cuts.tolist(), cuts[1:].tolist(), strict=False):
                data = ids[a:b].tobytes() + end
                n, start = len(data) // 4, 0
                for length in piece_lengths(n, longest):
                    piece = data[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(piece), n))
                    if with_ids:
                        all_ids.append(memoryview(piece).cast("i").tolist())
                    start += length
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, all_ids], schema, strict=False)], schema=schema)

    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c, _ in fields) + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", longest: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces with sequence_id and offset. A sequence is one piece, so ``offset`` is 0 and nothing is padded.

    The pieces are written once; what numbering then shuffles is their few numbers, not the ids.
    """
    pieces = materialise(piece_rows(docs, tokenizer, text_col, id_col, longest, end_id, with_ids), "pieces")
    parts = max(PARTS, pieces.count() // PART_PIECES)  # the count is in the footers of the files
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most a row for each part and power of two: a millionth of the pieces
    before = sizes.select(
        "length", "part", (F.sum("n").over(Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before")
    )
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    return (
        pieces.withColumn("rank", F.row_number().over(order) - 1)
        .join(before, ["length", "part"])
        .withColumn("sequence_id", (F.col("before") + F.col("rank")).cast("long"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("part", "rank", "before")
    )
