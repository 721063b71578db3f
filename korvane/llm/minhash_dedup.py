"""Near-duplicates by DartMinHash: weighted signatures from hashed darts, banded joining, exact verification.

Signatures. The weight of an element (a shingle of five words) is how often the text has it. An element owns a region as
wide as its weight. Darts are thrown at the plane of (weight, rank): those of one unit of an element's weight form a
Poisson process along the rank, drawn by a hash of the element alone. A dart whose place is above the element's weight
misses. A document keeps, for each coordinate, its earliest dart. Two documents agree there with the probability of
their weighted Jaccard similarity, the sum of the lesser weights over that of the greater ones. Only darts up to a rank
that covers all coordinates are drawn, so the work is about k log k + n and not k * n.

Joining. Equal texts are one node. Bands of a signature are bucket keys.

1. Of each bucket the node that meets most others leads, and all others are compared with it by their whole weighted
   sets. Links are contracted to classes. So a bucket of alike nodes costs its size and not its square.
2. All nodes that met one leader are its group. In groups of several classes, each node is written as its difference
   from the leader's set. What two sets have in common follows from two such differences exactly, and these are small.
   All nodes outside of a group's largest class are compared so with all nodes of other classes, in numpy: nodes stream
   past an inverted index of at most ``BLOCK`` elements, a large group is dealt out over blocks and tasks, and a node
   gives one row for each class that it links to, never one for each pair.

Two nodes of a bucket meet the same leader, so each pair of them that isn't of one class already is compared exactly:
what bands bring together loses no link.

Nulls and ties: texts without a word (null too) are alike to none. Texts of one to four words have one shingle, all
their words. Equal rows are one class. class_id is the smallest doc_id of the class, null if it has none. Of nodes that
meet equally many the one with the largest number leads; classes don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, let_go, materialise, small_batches

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5  # at a similarity of 0.8, about 3 in a million pairs share no band
#: Elements in a block's index, elements that stream past it in one task, and counters of one numpy step: they only
#: steer the cost.
BLOCK, STREAM, COUNTERS = 1 << 20, 1 << 18, 1 << 22
#: Copies of a group's few numbers, so that its nodes needn't come to one task for them.
SPREAD = 16
#: Bytes of text for one numpy step; a longer text is a step of its own.
STEP = 1 << 20
NO_ID = -(2**63)

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C55
    up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 2**64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_BYTE = mix(np.arange(1, 257, dtype=_U) * _GOLD)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts, in order and with repeats, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data] * up[: len(data)])])
    word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    bound = np.searchsorted(starts, first)
    n_words = np.diff(bound)
    out = np.zeros(len(word), _U)
    salt = mix(np.arange(1, words + 1, dtype=_U))
    padded = np.concatenate([word, np.zeros(words - 1, _U)])
    place = np.arange(len(word)) - np.repeat(bound[:-1], n_words)
    left = np.repeat(n_words, n_words) - place
    for k in range(words):
        out += np.where(left > k, padded[k : k + len(word)], _U(0)) * salt[k]
    keep = (left >= words) | ((place == 0) & (left < words))
    return mix(out[keep] + np.minimum(left, words)[keep].astype(_U)), np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))


def weighed(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, how often it has them, and how many it has."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return found[at], np.diff(np.append(at, len(found))).astype(np.float64), np.bincount(doc[at], minlength=len(counts))


def layers(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One element for each unit of weight, which element it is of, and its share of a unit (the last one may be a part)."""
    n = np.ceil(weights).astype(np.int64)
    level = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(elements, n) + level.astype(_U) * _GOLD), np.repeat(np.arange(len(n)), n), np.minimum(np.repeat(weights, n) - level, 1.0)


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, counts: np.ndarray, k: int) -> np.ndarray:
    """(documents, k) hashes of the earliest dart of each coordinate; a document without elements has zeros.

    ``weights`` are positive, one for each element; None is 1 each. Elements that repeat count once.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    share = None
    if weights is not None:
        elements, of, share = layers(elements, weights)
        doc = doc[of]
        share = None if (share == 1.0).all() else share
    mass = np.bincount(doc, minlength=len(counts))
    best = np.full(len(counts) * k, np.inf)
    out = np.zeros(len(counts) * k, _U)
    todo = mass > 0
    reach = np.where(todo, k * (np.log(k) + 6) / np.maximum(mass, 1), 0.0)
    while todo.any():
        at = np.flatnonzero(todo[doc])
        x, d = elements[at], doc[at]
        part = None if share is None else share[at]
        rank, turn = np.zeros(len(x)), 0
        while len(x):
            turn += 1
            h = mix(x + _U(turn * int(_GOLD) % 2**64))
            rank = rank - np.log((h >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            near = rank <= reach[d]
            x, d, rank, h = x[near], d[near], rank[near], h[near]
            if part is not None:
                part = part[near]
            dart = mix(h ^ _U(0xD6E8FEB86659FD93))
            slot = d * k + (dart % _U(k)).astype(np.int64)
            mine = dart
            ranks = rank
            if part is not None:
                hit = (mix(dart + _GOLD) >> _U(11)).astype(np.float64) * 2.0**-53 < part
                slot, mine, ranks = slot[hit], dart[hit], rank[hit]
            np.minimum.at(best, slot, ranks)
            won = best[slot] == ranks
            out[slot[won]] = mine[won]
        empty = np.isinf(best.reshape(len(counts), k)).any(axis=1)
        todo &= empty
        reach = reach * 4  # and again for the few that left a coordinate empty
    return out.reshape(len(counts), k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) bucket keys; the band is part of its key."""
    parts = signatures.reshape(len(signatures), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U)), (len(signatures), bands)).copy()
    for r in range(rows):
        out = mix(out * _GOLD + parts[:, :, r])
    return out


def _steps(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about STEP bytes, and where each begins."""
    begin, size, some = 0, 0, []
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if some and size + len(data) > STEP:
            yield begin, some
            begin, size, some = i, 0, []
        some.append(data)
        size += len(data) + 1
    if some:
        yield begin, some


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64).ravel())


def nodes_of(docs: DataFrame, text_col: str, id_col: str, bands: int, rows: int, words: int) -> DataFrame:
    """A row for each document: uid, doc_id, text_hash, k1 and k2 (of its words), and its bucket keys."""
    fields = [("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for begin, texts in _steps(batch.column(3).to_pylist()):
                elements, weights, counts = weighed(*shingles(texts, words))
                keys = band_keys(dart_signatures(elements, weights, counts, bands * rows), bands, rows)
                words_hash = b"".join(xxhash.xxh3_128_digest(b" ".join(t.split())) for t in texts)
                halves = [pa.array(h, mask=counts == 0) for h in np.frombuffer(words_hash, ">i8").astype(np.int64).reshape(-1, 2).T.copy()]
                has = np.cumsum([0, *[bands * bool(n) for n in counts]])
                lists = pa.ListArray.from_arrays(pa.array(has, pa.int32()), _signed(keys[counts > 0]))
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *halves, lists], schema=schema)

    text = F.col(f"`{text_col}`")
    rows_ = small_batches(docs).select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )
    return rows_.mapInArrow(run, "uid long, doc_id long, text_hash long, k1 long, k2 long, bands array<long>")


def weighted_sets(docs: DataFrame, members: DataFrame, text_col: str, id_col: str, words: int) -> DataFrame:
    """(uid, units) for ``members`` (uid, doc_id, text_hash), from their texts.

    A set has an element for each unit of weight, so the common elements of two sets are the sum of the lesser weights.
    """
    schema = pa.schema([("uid", pa.int64()), ("units", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for begin, texts in _steps(batch.column(1).to_pylist()):
                elements, weights, counts = weighed(*shingles(texts, words))
                units, of, _ = layers(elements, weights)
                sizes = np.bincount(np.repeat(np.arange(len(counts)), counts)[of], minlength=len(counts))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), _signed(units))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), lists], schema=schema)

    text = F.col(f"`{text_col}`")
    left = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    right = members.select("uid", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_hash")
    return left.join(right, ["id", "text_hash"]).select("uid", "text").mapInArrow(run, "uid long, units array<long>").dropDuplicates(["uid"])


def differences(group: DataFrame, sets: DataFrame) -> DataFrame:
    """(leader, uid, label, size, base, lacks, delta) of rows (leader, uid, label).

    ``delta`` has what only one of node and leader has, ``lacks`` counts those of the leader, ``base`` is its size.
    """
    x, y = sets.select("uid", F.col("units").alias("x")), sets.select(F.col("uid").alias("leader"), F.col("units").alias("y"))
    both = group.join(x, "uid").join(y, "leader").select("leader", "uid", "label", "x", F.size("y").alias("base"), F.array_except("y", "x").alias("lacking"), F.array_except("x", "y").alias("own"))
    return both.select("leader", "uid", "label", F.size("x").alias("size"), "base", F.size("lacking").alias("lacks"), F.concat("lacking", "own").alias("delta"))


class Nodes(NamedTuple):
    """Columns of some nodes of a group; ``ends`` are where each one's differences end in ``delta``."""

    uid: np.ndarray
    label: np.ndarray
    size: np.ndarray
    lacks: np.ndarray
    ends: np.ndarray
    delta: np.ndarray

    @classmethod
    def joined(cls, parts: list[Nodes]) -> Nodes:
        before = np.cumsum([0, *(len(p.delta) for p in parts)])
        ends = [p.ends + b for p, b in zip(parts, before, strict=False)]
        return cls(*(np.concatenate([p[k] for p in parts]) for k in range(4)), np.concatenate(ends), np.concatenate([p.delta for p in parts]))

    def part(self, a: int, b: int) -> Nodes:
        first, last = (int(self.ends[k - 1]) if k else 0 for k in (a, b))
        return Nodes(self.uid[a:b], self.label[a:b], self.size[a:b], self.lacks[a:b], self.ends[a:b] - first, self.delta[first:last])


class Block:
    """An inverted index over the differences of some nodes from their leader's set of ``base`` elements."""

    def __init__(self, nodes: Nodes, base: int):
        self.nodes, self.base = nodes, base
        order = np.argsort(nodes.delta, kind="stable")
        self.owner = np.repeat(np.arange(len(nodes.uid)), np.diff(nodes.ends, prepend=0))[order]
        self.elements, self.first, self.n = np.unique(nodes.delta[order], return_index=True, return_counts=True)

    def links(self, others: Nodes, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(uids of others, uids here) of pairs at least so similar: one for each other node and class here, not its own."""
        width = len(self.nodes.uid)
        at = np.minimum(np.searchsorted(self.elements, others.delta), max(0, len(self.elements) - 1))
        hit = self.elements[at] == others.delta if len(self.elements) else np.zeros(len(at), bool)
        row = np.repeat(np.arange(len(others.uid)), np.diff(others.ends, prepend=0))[hit]
        at = at[hit]
        cost = np.maximum(width, np.bincount(row, self.n[at], len(others.uid)))
        step = (np.cumsum(cost) // COUNTERS).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            these = slice(*np.searchsorted(row, [a, b]).tolist())
            n = self.n[at[these]]
            ends = np.cumsum(n)
            owner = self.owner[np.repeat(self.first[at[these]] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            shared = np.bincount(np.repeat(row[these] - a, n) * width + owner, minlength=(b - a) * width).reshape(b - a, width)
            common = self.base - others.lacks[a:b, None] - self.nodes.lacks + shared
            like = common >= similarity * (others.size[a:b, None] + self.nodes.size - common)
            i, j = np.nonzero(like & (others.label[a:b, None] != self.nodes.label))
            _, once = np.unique(np.stack([i, self.nodes.label[j]]), axis=1, return_index=True)
            yield others.uid[a:b][i[once]], self.nodes.uid[j[once]]


def links_within(group: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of alike nodes of different classes of a group, from ``differences``: all that joining the classes needs."""
    units = F.size("delta") + 1
    held = group.groupBy("leader", "label").agg(F.count("*").alias("n"), F.sum(units).alias("units"))
    held = held.groupBy("leader").agg(F.sum("units").alias("units"), F.max(F.struct("n", "label", "units")).alias("most"))
    parts = held.select("leader", "most", F.ceil((F.col("units") - F.col("most.units")) / BLOCK).alias("blocks"), F.ceil(F.col("units") / STREAM).alias("salts"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    some = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(n))
    copies = parts.withColumn("spread", F.lit(SPREAD).cast("long")).withColumn("copy", every("spread")).drop("spread")
    rows = group.withColumn("spread", F.lit(SPREAD).cast("long")).withColumn("copy", some("spread", 3)).drop("spread").join(copies.hint("merge"), ["leader", "copy"])  # their size isn't bounded
    columns = ("leader", "block", "salt", "past", "uid", "label", "size", "lacks", "base", "delta")
    block = rows.where(F.col("label") != F.col("most.label")).select("*", some("blocks", 1).alias("block"), every("salts").alias("salt"), F.lit(0).alias("past"))
    past = rows.select("*", every("blocks").alias("block"), some("salts", 2).alias("salt"), F.lit(1).alias("past"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        place, waiting, index = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("leader", "block", "salt", "past")], axis=1)
            base, lists = batch.column("base").to_numpy(), batch.column("delta")
            nodes = Nodes(*(batch.column(c).to_numpy() for c in ("uid", "label", "size", "lacks")), np.cumsum(lists.value_lengths().to_numpy()), lists.flatten().to_numpy())
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if place != tuple(key[a, :3]):
                    place, waiting, index = tuple(key[a, :3]), [], None
                if not key[a, 3]:
                    waiting.append(nodes.part(a, b))
                elif index or waiting:
                    index = index or Block(Nodes.joined(waiting), int(base[a]))
                    for x, y in index.links(nodes.part(a, b), similarity):
                        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], schema=schema)

    streams = block.select(*columns).unionByName(past.select(*columns)).repartition("leader", "block", "salt")
    return streams.sortWithinPartitions("leader", "block", "salt", "past").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity."""
    a = sets.select(F.col("uid").alias("a"), F.col("units").alias("x"))
    b = sets.select(F.col("uid").alias("b"), F.col("units").alias("y"))
    both = pairs.join(a, "a").join(b.where(F.size("y") > 0), "b")
    near = F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y"))
    common = F.size(F.array_intersect("x", "y"))
    like = common >= similarity * (F.size("x") + F.size("y") - common)
    return both.where(F.when(near, like).otherwise(False)).select("a", "b")


def linked(nodes: DataFrame, docs: DataFrame, text_col: str, id_col: str, words: int, similarity: float) -> DataFrame:
    """(uid, label): the classes of all verified links; ``nodes`` has a row for each different text."""
    rows = nodes.select("uid", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = materialise(rows.join(sizes, "bucket"), "crowded")
    met = materialise(crowded.groupBy("uid").agg(F.sum("n").alias("met")), "met")
    members = nodes.join(met.select("uid"), "uid", "left_semi").select("uid", "doc_id", "text_hash")
    sets = materialise(weighted_sets(docs, members, text_col, id_col, words), "sets")
    lead = crowded.join(met, "uid").groupBy("bucket").agg(F.max(F.struct("met", "uid")).alias("top")).select("bucket", F.col("top.uid").alias("leader"))
    groups = materialise(crowded.join(lead, "bucket").where(F.col("uid") != F.col("leader")).select("leader", "uid").distinct(), "groups")
    links = materialise(verified(groups.select(F.col("uid").alias("a"), F.col("leader").alias("b")), sets, similarity), "links")
    labels = components(links)
    known = groups.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    several = known.groupBy("leader").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("leader")
    further = materialise(links_within(materialise(differences(known.join(several, "leader"), sets), "differences"), similarity), "links")
    return labels if further.isEmpty() else components(links.unionByName(further))


def components(pairs: DataFrame) -> DataFrame:
    """(uid, label): the smallest uid of each node's component; nodes without a pair are absent.

    Labels take the smallest of their neighbours and then jump to their label's label, so a few rounds do.
    """
    edges = materialise(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialise(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "uid"), "labels")
    while True:
        heard = edges.join(labels.select(F.col("uid").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        lower = materialise(
            labels.join(heard.withColumnRenamed("a", "uid"), "uid").select("uid", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("moved")), "labels"
        )
        jump = lower.select(F.col("uid").alias("label"), F.col("label").alias("next"))
        if not lower.agg(F.coalesce(F.bool_or("moved"), F.lit(False))).first()[0]:
            return lower.select("uid", "label")
        labels = materialise(lower.join(jump, "label").select("uid", F.col("next").alias("label")), "labels")


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each document: uid, doc_id, text_hash, class_id, and whether it is the one of its class to stay."""
    all_nodes = materialise(nodes_of(docs, text_col, id_col, bands, rows, words), "nodes")
    wordy = all_nodes.where(F.col("k1").isNotNull())
    texts = materialise(
        wordy.groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "uid")).alias("best")), "texts"
    )
    reps = wordy.join(texts.select(F.col("rep").alias("uid")), "uid", "left_semi")
    labels = linked(reps, docs, text_col, id_col, words, similarity)
    labelled = texts.join(labels.withColumnRenamed("uid", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    best = labelled.groupBy("label").agg(F.min("best").alias("top"))
    named = labelled.join(best, "label").select("k1", "k2", "top")
    out = all_nodes.join(named, ["k1", "k2"], "left")
    class_id = F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("top.id"), F.lit(2**63 - 1)))
    return out.select("uid", "doc_id", "text_hash", class_id.alias("class_id"), F.coalesce(F.col("top.uid") == F.col("uid"), F.lit(True)).alias("stays"))


def dedup_near(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest doc_id. Rows without a word all stay."""
    key, h = fresh(docs, "_id"), fresh(docs, "_hash")
    goes = classes(docs, text_col, id_col, similarity)
    same = goes.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias(key), F.col("text_hash").alias(h)).agg(
        F.count_if("stays").alias("_stay"), F.count("*").alias("_all")
    )
    keyed = docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))).withColumn(h, F.xxhash64(F.col(f"`{text_col}`")))
    once = same.where("_stay > 0 AND _stay < _all").select(key, h)  # rows of one id and text: one of them stays
    whole = same.where("_stay = _all").select(key, h)
    return (
        keyed.join(whole, [key, h], "left_semi")
        .unionByName(keyed.join(once, [key, h], "left_semi").dropDuplicates([key, h]))
        .drop(key, h)
    )
