"""Byte-level BPE as a finite-state transducer, determinised while it runs.

A sequence of tokens is what BPE gives for its bytes just if BPE of each two neighbours' bytes gives those two. So a
nondeterministic transducer needs to remember only the last token and how far it is into the next one (a place in the
vocabulary's trie). Its determinised states are sets of (place, last token, tokens not yet emitted); a state is made
when a byte first leads to it. What all members agree on is emitted, which is at most the longest token's bytes late.

Decoding feeds token bytes through an incremental UTF-8 decoder and gives only whole characters until the end.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, small_batches
from .tokens import PieceStore

ROOT = 0
#: Determinised states (and pairs of tokens) kept in a worker; beyond it they are made anew, in the middle of a text too.
MAX_STATES = 350_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


NONE = 1 << 60


def merge(piece: bytes, ranks: dict[bytes, int], border: int = 0) -> list[bytes]:
    """BPE by its definition: the leftmost pair of the lowest rank is joined until none has a rank.

    With a ``border`` inside the piece it stops, and returns nothing, once a token would lie across it.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank = [ranks.get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while rank:
        least = min(rank)
        if least == NONE:
            break
        i = rank.index(least)
        if i + 1 == border:
            return []
        if i < border:
            border -= 1
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], NONE)
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
    return parts


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.child: dict[int, int] = {}  # place * 256 + byte -> place
        self.token_at: dict[int, int] = {}
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            place = ROOT
            for b in token:
                place = self.child.setdefault(place << 8 | b, len(self.child) + 1)
            self.token_at[place] = rank
        self.inner = {key >> 8 for key in self.child}
        self.fits: dict[int, bool] = {}
        self.states: list[tuple] = [((ROOT, -1, ()),)]
        self._forget()

    def _forget(self, but: int = 0) -> int:
        """Start anew with no state but the first and one more, whose number is given back."""
        kept, start = self.states[but], ((ROOT, -1, ()),)
        self.states, self.numbers = [start], {start: 0}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}
        if len(self.fits) > MAX_STATES:
            self.fits.clear()
        if kept == start:
            return 0
        self.states.append(kept)
        self.numbers[kept] = 1
        return 1

    def _follows(self, last: int, token: int) -> bool:
        """Whether BPE can give ``token`` right after ``last`` (-1: at the start)."""
        if last < 0:
            return merge(self.bytes_of[token], self.ranks) == [self.bytes_of[token]]
        a, b = self.bytes_of[last], self.bytes_of[token]
        return merge(a + b, self.ranks, len(a)) == [a, b]

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state that ``byte`` leads to, and what is emitted on the way."""
        members, ended, fits = [], None, self.fits
        for place, last, waiting in self.states[number]:
            to = self.child.get(place << 8 | byte)
            if to is None:
                continue
            if ended is None and (token := self.token_at.get(to)) is not None:
                pair = last << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = self._follows(last, token)
                if fit:
                    ended = (ROOT, token, (*waiting, token))
            if to in self.inner:
                members.append((to, last, waiting))
        if ended is None:
            raise ValueError("the vocabulary lacks a byte")
        members.append(ended)
        mine = ended[2]
        shared = len(mine)
        for _, _, waiting in members:
            k = 0
            for x, y in zip(waiting, mine, strict=False):
                if x != y:
                    break
                k += 1
            shared = min(shared, k)
            if not shared:
                break
        state = tuple((place, last, waiting[shared:]) for place, last, waiting in members) if shared else tuple(members)
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        self.next[number << 8 | byte] = out = to, mine[:shared]
        return out

    def feed(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of a stream of bytes, as soon as nothing can change them."""
        state, known = 0, self.next.get
        for byte in data:
            found = known(state << 8 | byte)
            if found is None:
                found = self._step(state, byte)
                if len(self.states) > MAX_STATES:
                    found = self._forget(found[0]), found[1]
                    known = self.next.get
            state, ready = found
            if ready:
                yield from ready
        if state:
            yield from self.states[state][-1][2]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else list(self.feed(piece))


class StreamDecoder:
    """Text from token ids that come in parts; a character that isn't whole yet waits."""

    def __init__(self, bytes_of: list[bytes], errors: str = "replace"):
        self.bytes_of, self.machine = bytes_of, codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        return self.machine.decode(b"", True)


class ByteBpe(PieceStore):
    """Texts to little-endian unsigned 32-bit ids and back."""

    def __init__(self, path: str, pattern: str):
        super().__init__(keeps_space=True)
        self.fst = Transducer(load_ranks(path))
        self.pattern = regex.compile(pattern)

    def _learn(self, pieces: list[str | tuple[str]]) -> None:
        """Words of a piece are kept as well; they have two or more in common."""
        store, old = self.store, self.old
        for piece in pieces:
            if piece in old:
                store[piece] = old[piece]
                continue
            ids = []
            for word in self.pattern.findall(piece[0] if isinstance(piece, tuple) else piece if piece.startswith("\n") else " " + piece):
                key = ("", word)
                known = store.get(key) or old.get(key)
                if known is None:
                    known = array("I", self.fst.encode(word.encode())).tobytes()
                    if len(word) < 64:
                        store[key] = known
                ids.append(known)
            store[piece] = b"".join(ids)

    def decode(self, ids: bytes, at_once: int = 4096) -> str:
        decoder = StreamDecoder(self.fst.bytes_of)
        numbers = np.frombuffer(ids, "<u4").tolist()
        parts = [decoder.feed(numbers[i : i + at_once]) for i in range(0, len(numbers), at_once)]
        return "".join([*parts, decoder.end()])


def codec(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker."""
    return held(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): every text encoded, and decoded from its ids.

    A null text is the empty one and has no ids. Rows that repeat, null ids and empty tables pass through.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    return _mapped(docs, path, pattern, text_col, id_col, schema, lambda ids, text: (ids, text), "ids binary, decoded string")


def digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """As ``round_trip``, but of the ids and the decoded bytes only their SHA-256, so that these needn't go back."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    digest = lambda ids, text: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return _mapped(docs, path, pattern, text_col, id_col, schema, digest, "ids_sha256 string, decoded_sha256 string")


def _mapped(docs, path, pattern, text_col, id_col, schema, made, ddl) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            ids = bpe.encode(batch.column(1))
            rows = [made(x, bpe.decode(x)) for x in ids]
            columns = [batch.column(0), [len(x) // 4 for x in ids], [a for a, _ in rows], [b for _, b in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {ddl}")
