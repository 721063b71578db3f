"""Where chunks lie in their documents, and how much of a document its chunks give back.

A document and its chunks meet by the document's id, each text moving once, and a task reads them one document at a time.
Three tokens in a row are a shingle, hashed with its place; of every WINDOW shingles in a row the one of the smallest hash is
kept, on both sides, so that a run that document and chunk share always shares one. Each shingle that both have votes for the
place where the chunk would begin, and the three places of most votes are compared exactly, by the longest common subsequence
of tokens. A document is cut into tokens once, when a chunk first asks for it.

A shingle that one text has more than REPEATS times votes from the first of these places, so that pairs grow with the texts
and not with their square; a chunk of nothing else is found where it occurs first. Chunks of fewer than WINDOW + 2 tokens
that lie inside a longer text may not be found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache, cached_property
from itertools import repeat
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvane.session import small_batches

SHINGLE, WINDOW, REPEATS, PLACES = 3, 6, 8, 3
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is part of a word, whether it isn't white space, and one more than what it is in lower case."""
    points = [chr(c) for c in range(0x110000)]
    word = np.fromiter((c.isalnum() or c == "_" for c in points), bool, len(points))
    dark = np.fromiter((not c.isspace() for c in points), bool, len(points))
    low = np.fromiter((ord(x) + 1 if len(x := c.lower()) == 1 else ord(c) + 1 for c in points), np.uint64, len(points))
    return word, dark, low


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, from 0 on, 2^bits of each."""
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(1 << bits, base, np.uint64)
        powers[0] = 1
        with np.errstate(over="ignore"):
            found.append(np.multiply.accumulate(powers))
    return found[0], found[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positioned_tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the tokens of a text: words, and other characters but white space, each alone; case doesn't count."""
    word, dark, low = _characters()
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.intp)
    in_word, shown = word[points], dark[points]
    after = np.zeros(len(points) + 1, bool)  # both sides of a place are in a word
    np.logical_and(in_word[1:], in_word[:-1], out=after[1:-1])
    begins = np.flatnonzero(shown & ~after[:-1])
    ends = np.flatnonzero(shown & ~after[1:]) + 1
    # a polynomial of the characters, whose prefix sums give that of any token
    with np.errstate(over="ignore"):
        powers, inverse = _powers(max(16, len(points).bit_length()))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.add.accumulate(low[points] * powers[: len(points)], out=sums[1:])
        hashes = _mixed((sums[ends] - sums[begins]) * inverse[begins])
    return hashes, begins, ends


def marks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, place) of the shingles that are kept of a text."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        shingles = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            shingles = _mixed(shingles * np.uint64(31) + hashes[i : i + n])
    width = min(WINDOW, n)
    least, ahead = shingles[: n - width + 1].copy(), np.zeros(n - width + 1, np.uint8)
    for i in range(1, width):  # of equal ones the last, so that a run of them keeps one of each window
        here = shingles[i : n - width + 1 + i]
        np.putmask(ahead, here <= least, i)
        np.minimum(here, least, out=least)
    last = np.arange(n - width + 1) + ahead  # never falls
    places = last[np.concatenate([[True], last[1:] != last[:-1]])]
    kept = shingles[places]
    order = np.argsort(kept, kind="stable")
    same = np.concatenate([[0], np.cumsum(np.diff(kept[order]) != 0)]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.searchsorted(same, same)
    chosen = np.sort(order[rank < REPEATS])
    return kept[chosen].view(np.int64), places[chosen]


class Located:
    """A document in which chunks are looked for; its tokens and shingles are made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text

    @cached_property
    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return positioned_tokens(self.text)

    @cached_property
    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        shingles, places = marks(self.tokens[0])
        order = np.argsort(shingles, kind="stable")
        return shingles[order], places[order]

    def starts(self, chunk: np.ndarray) -> list[int]:
        """Where the tokens of a chunk would begin by most votes, PLACES places at most; of as many votes the first."""
        own, places = marks(chunk)
        shingles, there = self.shingles
        first = np.searchsorted(shingles, own)
        n = np.searchsorted(shingles, own, "right") - first
        pairs = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        begins, votes = np.unique(there[pairs] - np.repeat(places, n), return_counts=True)
        return begins[np.argsort(-votes, kind="stable")[:PLACES]].tolist()


def common(a: Sequence[int], b: Sequence[int]) -> int:
    """The length of the longest common subsequence."""
    return commons(a, [b])[0]


def commons(a: Sequence[int], others: Sequence[Sequence[int]]) -> list[int]:
    """That of a with each of some others, which are of one length.

    A bit stands for a token of a, and a run of bits, with one more for what is carried out of it, for each of the others.
    """
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole, lanes = (1 << len(a)) - 1, range(0, len(others) * (len(a) + 1), len(a) + 1)
    row = mask = sum(whole << at for at in lanes)
    steps = None
    for at, other in zip(lanes, others, strict=True):
        known = {x: bits << at for x, bits in places.items()} if at else places
        found = map(known.get, other, repeat(0))
        steps = found if steps is None else map(or_, steps, found)
    for bits in steps or ():
        match = row & bits
        row = ((row + match) | (row - match)) & mask
    return [len(a) - (row >> at & whole).bit_count() for at in lanes]


def best_place(document: tuple[np.ndarray, np.ndarray, np.ndarray], chunk: np.ndarray, starts: Sequence[int]) -> tuple[int, int, float]:
    """(start, end, similarity) of the run of as many tokens as the chunk has that is most like it, among some; -1 for none."""
    hashes, begins, ends = document
    n, best = len(chunk), (-1, -1, 0.0)
    at = sorted({min(max(0, s), max(0, len(hashes) - n)) for s in starts})
    windows = [hashes[start : start + n].tolist() for start in at]  # of one length
    for start, window, both in zip(at, windows, commons(chunk.tolist(), windows), strict=True):
        like = 2 * both / (n + len(window)) if window else 0.0
        if like > best[2]:
            best = int(begins[start]), int(ends[start + len(window) - 1]), like
    return best


def locate(documents: DataFrame, chunks: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(doc_id, chunk_no, start, end, similarity, matched) of chunks (doc_id, chunk_no, text) in documents (doc_id, text).

    Places are in characters, -1 and a similarity of 0 where nothing votes. Ids should be unique; a null id takes no part.
    A document and its chunks are the work of one task, which holds one document's tokens and one batch of texts.
    """
    own, given = (
        rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.lit(chunk).alias("chunk"), number.cast("long").alias("chunk_no"), "text")
        for rows, chunk, number in ((documents, False, F.lit(None)), (chunks, True, F.col("chunk_no")))
    )
    names = ["doc_id", "chunk_no", "start", "end", "similarity", "matched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wholes = None, []  # the document of this id; more if the id repeats
        for batch in batches:
            rows = []
            for doc_id, chunk, number, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if at != doc_id:
                    at, wholes = doc_id, []
                if not chunk:
                    wholes.append(Located(text))
                    continue
                part = positioned_tokens(text)[0] if wholes and number is not None else None
                for whole in wholes or [None]:
                    found = (-1, -1, 0.0)
                    if part is not None and (starts := whole.starts(part)):
                        found = best_place(whole.tokens, part, starts)
                    rows.append((doc_id, number, found[0], found[1], round(found[2], 6), found[2] >= threshold))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64(), pa.bool_()], strict=True)], names=names)

    together = small_batches(own.unionByName(given)).repartition("doc_id").sortWithinPartitions("doc_id", "chunk")  # a document before its chunks
    return together.mapInArrow(run, "doc_id long, chunk_no long, start long, end long, similarity double, matched boolean")


WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def coverage_ratio(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, ratio, n_missing, n_added): how much of each document (doc_id, text) its chunks (doc_id, chunk_no, text) give back.

    Twice the words that both have, each as often as in the poorer, over the words of both together: 1 if nothing is
    missing or added, and 1 for a document without words whose chunks have none. Words that aren't given back are missing.
    Rows of one id count together; a null id is a document that no chunk gives back, and has no words.

    Texts move once, as their words, and come to a task sorted by document, where the words of one document at a time are
    counted: memory is for the different words of one, a document and its chunks are the work of one task.
    """
    kind = documents.schema["doc_id"].dataType
    own, given = (
        rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast(kind), F.lit(chunk).alias("chunk"), F.array_join(words(F.col("text")), " ").alias("words"))
        for rows, chunk in ((documents, False), (chunks, True))
    )
    numbers = ("both", "own", "given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, (Counter(), Counter())

        def sums() -> tuple[int, ...]:
            mine, theirs = counts
            return sum(min(n, theirs[w]) for w, n in mine.items() if w in theirs), mine.total(), theirs.total()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            ids = pa.array([r[0] for r in rows], id_type)
            return pa.RecordBatch.from_arrays([ids, *[pa.array([r[1][i] for r in rows], pa.int64()) for i in range(3)]], names=["doc_id", *numbers])

        for batch in batches:
            id_type, done = batch.column(0).type, []
            for doc_id, chunk, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if at != doc_id:
                    if at is not None:
                        done.append((at, sums()))
                    at, counts = doc_id, (Counter(), Counter())
                counts[chunk].update(text.split())
            if done:
                yield out(done)
        if at is not None:
            yield out([(at, sums())])

    sorted_rows = own.unionByName(given).repartition("doc_id").sortWithinPartitions("doc_id")
    counted = sorted_rows.mapInArrow(run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in numbers))
    found = documents.select("doc_id").join(counted, "doc_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    ratio = F.coalesce(F.try_divide(2.0 * number("both"), number("own") + number("given")), F.lit(1.0))
    return found.select("doc_id", F.round(ratio, 6).alias("ratio"), (number("own") - number("both")).alias("n_missing"), (number("given") - number("both")).alias("n_added"))
