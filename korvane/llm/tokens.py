"""Token ids of whole texts by a public tokenizer, with what one text shares with others encoded once.

Both vocabularies split a text before its single spaces, so a text is cut there and each distinct piece is encoded
once by a worker; the ids are those of the whole text. Where white space stands around a space, byte-level
vocabularies join it, and the whole text is encoded instead. Plain words are encoded many to a call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import held

#: Pieces in a worker's store, or in a generation of it. Two generations are kept: what the younger one lacks and the older
#: one has moves on, the rest goes. This bounds memory and costs time only.
CACHE_PIECES = 300_000
#: Bytes of the pieces and ids that an encoder keeps between batches.
CACHE_BYTES = 1 << 26
#: Batches are joined up to so many bytes, so that a piece of several is looked up once.
BATCH_BYTES = 1 << 23
#: White space on both sides of a space, three in a row, two at the end, before the text, or alone; Arrow's \\s would be ASCII.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
JOINED = rf"{_SPACE} {_SPACE}|{_SPACE}{{3}}|{_SPACE}{{2}}\z|\A |\A{_SPACE}+\z"
#: Punctuation that both vocabularies encode apart from the letters before it.
TAIL = ".,;:!?"
#: Below it, Python and the tokenizers agree on what a letter is, and texts are in normal form C.
LATIN = "\u0130"
#: A word of such letters, or a line that begins with one.
LETTERS = rf"\A\n?[{''.join(c for c in map(chr, range(ord(LATIN))) if c.isalpha())}]+\z"


class PieceStore:
    """Encodes texts by their pieces, of which it keeps those met before; what a piece gives is up to ``_learn``.

    keeps_space: the space before a word belongs to it (byte-level).
    """

    def __init__(self, keeps_space: bool):
        self.keeps_space, self.store, self.old = keeps_space, {}, {}

    def _learn(self, pieces: list[str | tuple[str]]) -> None:
        """Put the ids of new pieces into the store, as bytes.

        A piece in a tuple begins its text, one with a line feed before it its line; others have a space before
        them, which byte-level ids hold.
        """
        raise NotImplementedError

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column (null: the empty text), and where those of each text begin and end."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        if self.keeps_space:
            whole = pc.match_substring_regex(texts, JOINED).to_numpy(zero_copy_only=False)
            cut = pc.replace_substring(pc.if_else(pa.array(whole), "", texts), "\n", " \n")  # no space before a line
        else:
            cut = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(cut, " ")
        coded = lists.flatten().dictionary_encode()
        code, distinct = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        firsts = lists.offsets.to_numpy()
        if self.keeps_space:  # the first piece of a text has no space before it, and stands for the whole if need be
            own = texts.filter(pa.array(whole)).to_pylist()
            begin = [(p,) for p in lists.flatten().take(pa.array(firsts[:-1])).to_pylist()]
            for i, text in zip(np.flatnonzero(whole).tolist(), own, strict=True):
                begin[i] = (text,)
            code[firsts[:-1]] = len(distinct) + np.arange(len(begin))
            distinct += begin
        if len(self.store) > CACHE_PIECES:
            self.store, self.old = {}, self.store
        self._learn(list(set(distinct).difference(self.store)))
        ids = [self.store[p] for p in distinct]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat, begins = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        n = sizes[code]
        ends = np.cumsum(n, dtype=np.int32)  # of one batch
        out = flat[np.repeat(begins[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        for p in own if self.keeps_space else ():  # whole texts aren't worth their place
            self.store.pop((p,), None)
        return out, np.concatenate([[0], ends])[firsts]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        ids, cuts = self.encode_column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


class PieceEncoder(PieceStore):
    """Encodes texts by the tokenizers library. Without ``keeps_space``, words end in a marked token.

    The strings of special tokens in a text give those tokens, as the library does by itself; with ``plain`` they are
    ordinary text, so that a document can't forge an end.

    Pieces are kept as columns, not as objects: an Arrow array of them, and for each its place and number among the ids.
    What a batch lacks is found by encoding the known pieces and its own by one dictionary.
    """

    def __init__(self, path: str, keeps_space: bool, plain: bool = False):
        super().__init__(keeps_space)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts with such a string aren't cut.
        self.special = None if plain or not special else "|".join(map(re.escape, special))
        size = self.tokenizer.get_vocab_size()
        self.line_feed = self.tokenizer.token_to_id("\u010a") if keeps_space else None  # as byte-level names it
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        #: Tokens that only the start (with the space) or only the end of a word has.
        self.edge = np.array([x.startswith("\u0120") if keeps_space else x.endswith("</w>") for x in names])
        self.known, self.ids = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.begins, self.sizes, self.met = (np.zeros(0, np.int32) for _ in range(3))  # met: in which batch last
        self.batch = 0

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = None  # texts that aren't cut
        if self.keeps_space:
            whole = pc.match_substring_regex(texts, JOINED)
        if self.special is not None:
            marked = pc.match_substring_regex(texts, self.special)
            whole = marked if whole is None else pc.or_(whole, marked)
        some = whole is not None and pc.any(whole).as_py()
        rest = pc.if_else(whole, "", texts) if some else texts
        lists = pc.split_pattern(pc.replace_substring(rest, "\n", " \n" if self.keeps_space else " "), " ")  # no space before a line
        firsts = lists.offsets.to_numpy()
        code = self._codes(lists.flatten())
        begins, sizes, ids = self.begins, self.sizes, self.ids
        if self.keeps_space:  # the first piece of a text has no space before it, and stands for the whole if need be
            at, begin = firsts[:-1], lists.flatten().take(pa.array(firsts[:-1]))
            if some:
                begin = pc.if_else(whole, texts, begin)
        elif some:
            at, begin = firsts[:-1][whole.to_numpy(zero_copy_only=False)], texts.filter(whole)
        if self.keeps_space or some:
            begun = begin.dictionary_encode()
            more, n = self._encode(begun.dictionary.to_pylist())
            code[at] = len(sizes) + begun.indices.to_numpy()
            begins, sizes, ids = np.concatenate([begins, len(ids) + np.cumsum(n, dtype=np.int32) - n]), np.concatenate([sizes, n]), np.concatenate([ids, more])
        n = sizes[code]
        ends = np.cumsum(n, dtype=np.int32)  # of one batch
        out = ids[np.repeat(begins[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        return out, np.concatenate([[0], ends])[firsts]

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of pieces among those known; new ones are learned first."""
        if not len(pieces):
            return np.zeros(0, np.int32)
        self._forget()
        own = pa.chunked_array([self.known, pieces]).dictionary_encode().chunks[-1]  # empty ones are left out
        code, old = own.indices.to_numpy().copy(), len(self.known)
        self.known = own.dictionary
        self._learn(self.known.slice(old))
        self.batch += 1
        self.met = np.concatenate([self.met, np.zeros(len(self.known) - len(self.met), np.int32)])
        self.met[code] = self.batch
        return code

    def _forget(self) -> None:
        """Of too many pieces, or too many bytes of them, those stay that were met last, half of the bounds at most."""
        if len(self.known) <= CACHE_PIECES and self.known.nbytes + self.ids.nbytes <= CACHE_BYTES:
            return
        order = np.argsort(-self.met, kind="stable")[: CACHE_PIECES // 2]
        length = pc.binary_length(self.known).to_numpy() + 4 * self.sizes
        kept = np.sort(order[np.cumsum(length[order], dtype=np.int64) <= CACHE_BYTES // 2])
        n = self.sizes[kept]
        ends = np.cumsum(n, dtype=np.int32)
        self.ids = self.ids[np.repeat(self.begins[kept] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        self.known, self.begins, self.sizes, self.met = self.known.take(pa.array(kept)), ends - n, n, self.met[kept]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter(chain.from_iterable(got), "<u4", int(sizes.sum())), sizes

    def _encode_starts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters that begin a line, each with the line feed before it; many to a call, cut again there."""
        ids, _ = self._encode(["\n" + "\n".join(words[i : i + 1000]) for i in range(0, len(words), 1000)])
        return ids, self._between(np.flatnonzero(ids == self.line_feed), len(ids), len(words))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters, with the space before each if that counts; many to a call, cut again at the tokens of their edge."""
        lead = " " if self.keeps_space else ""
        ids, _ = self._encode([lead + " ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)])
        edges = np.flatnonzero(self.edge[ids])
        if not self.keeps_space:  # a word's last token
            edges = np.concatenate([[0], edges + 1])[: len(edges)]
        return ids, self._between(edges, len(ids), len(words))

    @staticmethod
    def _between(cuts: np.ndarray, end: int, words: int) -> np.ndarray:
        if len(cuts) != words or (words and cuts[0]):
            raise AssertionError("a word has not one edge")
        return np.diff(cuts, append=end).astype(np.int32)

    def _learn(self, pieces: pa.Array) -> None:
        """The ids of new pieces, the next in ``known``; words of letters many to a call, those before punctuation with them."""
        stems = pc.utf8_rtrim(pieces, TAIL)
        lettered = pc.match_substring_regex(stems, LETTERS)
        tailed = pc.and_(lettered, pc.not_equal(pc.binary_length(stems), pc.binary_length(pieces)))
        spoken = pc.filter(stems, lettered).dictionary_encode()  # of a word and of it before punctuation, one
        words, fed = spoken.dictionary, pc.starts_with(spoken.dictionary, "\n")
        ids, begins, sizes = [self.ids], np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        at = len(self.ids)

        def put(got: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            nonlocal at
            ids.append(got[0])
            at += len(got[0])
            return at - len(got[0]) + np.cumsum(got[1], dtype=np.int32) - got[1], got[1]

        fed_at = fed.to_numpy(zero_copy_only=False)
        begins[~fed_at], sizes[~fed_at] = put(self._encode_words(words.filter(pc.invert(fed)).to_pylist()))
        begins[fed_at], sizes[fed_at] = put(self._encode_starts([w[1:] for w in words.filter(fed).to_pylist()]))

        own, of_word, with_tail = np.zeros((2, len(pieces)), np.int32), spoken.indices.to_numpy(), tailed.to_numpy(zero_copy_only=False)
        lettered_at = lettered.to_numpy(zero_copy_only=False)
        own[:, lettered_at] = begins[of_word], sizes[of_word]
        other = pieces.filter(pc.invert(lettered)).to_pylist()
        lead = " " if self.keeps_space else ""
        own[:, ~lettered_at] = put(self._encode([p if lead and p.startswith("\n") else lead + p for p in other]))

        # a word's ids and then those of its punctuation, as at the start of a text
        first, n = own[:, with_tail]
        kinds = pc.replace_substring_regex(pieces.filter(tailed), rf"\A[^{TAIL}]+", "").dictionary_encode()
        tail_begins, tail_sizes = put(self._encode(kinds.dictionary.to_pylist()))
        kind = kinds.indices.to_numpy()
        both = np.empty(2 * len(n), np.int32), np.empty(2 * len(n), np.int32)
        both[0][::2], both[0][1::2], both[1][::2], both[1][1::2] = first, tail_begins[kind], n, tail_sizes[kind]
        flat, ends = np.concatenate(ids), np.cumsum(both[1], dtype=np.int32)
        joined = flat[np.repeat(both[0] - (ends - both[1]), both[1]) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        ids = [flat]
        own[:, with_tail] = put((joined, n + tail_sizes[kind]))
        self.ids = np.concatenate(ids)
        self.begins, self.sizes = np.concatenate([self.begins, own[0]]), np.concatenate([self.sizes, own[1]])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES; longer ones stay as they are."""
    waiting, size = [], 0
    for batch in batches:
        if waiting and size + batch.nbytes > BATCH_BYTES:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
        waiting.append(batch)
        size += batch.nbytes
    if waiting:
        yield pa.concat_batches(waiting)


def encoder(path: str, keeps_space: bool, plain: bool = False) -> PieceEncoder:
    """One for each Python worker; a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("tokenizer", path, keeps_space, plain), lambda: PieceEncoder(path, keeps_space, plain))
