"""Hard negatives of embeddings, by exact search after an orthogonal PCA rotation.

Rows and anchors are packed into blocks; every block of anchors meets every block of rows in one tile of some task (for
positives, only blocks that share a bucket of labels). Within a tile a rotation concentrates the vectors in few leading
components. Their partial products, plus the product of the residual norms and some slack for rounding, bound each score
from above, all in one matrix product; what stays below an anchor's threshold is discarded. More components narrow the
bound for the rest, and the survivors' scores are products of integers, so the rotation and its rounding only steer the
cost. Thresholds are the worst of the best rows that a task has seen for an anchor, so they never discard a result.

The first pass finds the positives, the second the negatives, whose windows depend on the positives' scores. Anchors
are never broadcast: both sides are dealt over keys of a few blocks each, however many rows a label has.

Definitions. Rows with a null id, label or vector, or a component that is null or not finite, take no part; shorter vectors
count as ended by zeros. Rows of one id are one candidate, by the best of them, and one anchor, by the smallest (label,
vector). Equal scores go by the smaller id; an anchor is never its own positive or negative. Scores from 2^55 on are an
OverflowError. An empty table, or one without anchors, gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, materialise

ANCHOR_EVERY, POSITIVES, NEGATIVES, SCALE = 50, 5, 3, 256
#: Anchors and rows of a block; blocks of rows that a key has; buckets of labels. All only steer the cost.
ANCHOR_BLOCK, ROW_BLOCK, KEY_BLOCKS, BUCKETS = 512, 2048, 64, 256
#: Vectors longer than this are rotated in their first components alone, so that moments stay small.
ROTATED = 512
#: Shares of the squared lengths that the two bounds may leave out.
LEFT_OUT = (0.25, 0.06)
SLACK = 1e-9
LIMIT = float(1 << 55)
LOWEST = np.iinfo(np.int64).min
BLOCK = "bucket long, block long, ids binary, labels binary, low binary, high binary, ints binary"


def integers(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v in integers."""
    v = F.col(f"`{vector_col}`")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & v.isNotNull() & ~F.coalesce(odd, F.lit(False)))
    return usable.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of one matrix, ended by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def rotation(rows: DataFrame, width: int, left_out: tuple[float, ...] = LEFT_OUT) -> tuple[np.ndarray, list[int]]:
    """The principal axes of all rows as columns, and the leading components of each bound.

    Tasks sum the products of components, at most ROTATED^2 numbers each, and Spark sums those.
    """
    n = min(width, ROTATED)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros((n, n))
        for batch in batches:
            x = matrix(batch.column(0), width)[:, :n].astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(total.ravel())], names=["cell", "x"])

    cells = rows.select("v").mapInArrow(moments, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()  # n * n numbers
    sums = np.zeros(n * n)
    for cell, x in cells:
        sums[cell] = x
    values, axes = np.linalg.eigh(sums.reshape(n, n))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    whole = np.eye(width)
    whole[:n, :n] = axes
    rest = 1 - np.cumsum(values) / max(values.sum(), 1e-300)
    steps = {int(min(np.searchsorted(-rest, -x) + 1, max(1, width - 1))) for x in left_out}
    return whole, sorted(steps)


def blocks(rows: DataFrame, width: int, most: int, windows: bool = False) -> DataFrame:
    """``rows`` (vec_id, label, v, and arrays low and high if there are windows) in blocks of ``most`` of one bucket."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.binary()) for n, t in (f.split() for f in BLOCK.split(", "))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[tuple] = []

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            while held:
                bucket = held[0][0]
                same = [h for h in held if h[0] == bucket]  # neighbours: rows are sorted by bucket
                parts = [np.concatenate(x) for x in list(zip(*same, strict=True))[1:]]
                n = len(parts[0])
                stays = 0 if whole or len(same) < len(held) else n % most
                for a in range(0, n - stays, most):
                    cut = [p[a : min(a + most, n - stays)].tobytes() for p in parts]
                    number = int.from_bytes(np.random.default_rng().bytes(7), "little")
                    yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([number]), *[pa.array([c], pa.binary()) for c in cut]], schema=schema)
                del held[: len(same)]
                if stays:
                    held.append((bucket, *[p[n - stays :] for p in parts]))
                    return

        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            low, high = (matrix(batch.column(c), POSITIVES) if windows else np.zeros((len(buckets), 0), np.int64) for c in ("low", "high"))
            columns = (batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), low, high, matrix(batch.column("v"), width))
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            held += [(int(buckets[a]), *[c[a:b] for c in columns]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
            if sum(len(h[1]) for h in held) >= most:
                yield from flush(False)
        yield from flush(True)

    none = F.array().cast("array<long>")
    extra = ["low", "high"] if windows else [none.alias("low"), none.alias("high")]
    bucketed = rows.select(F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).alias("bucket"), "vec_id", "label", "v", *extra)
    # no shuffle: blocks of a task that aren't full only cost a little more
    return materialise(bucketed.sortWithinPartitions("bucket").mapInArrow(pack, BLOCK), "blocks")


class Block:
    """A block as arrays, with its vectors turned."""

    def __init__(self, ids: bytes, labels: bytes, low: bytes, high: bytes, ints: bytes, axes: np.ndarray, steps: list[int]):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        n = len(self.ids)
        self.low, self.high = (np.frombuffer(x, np.int64).reshape(n, -1) for x in (low, high))
        self.ints = np.frombuffer(ints, np.int64).reshape(n, -1)
        self.floats = self.ints.astype(np.float64)
        turned = self.floats @ axes
        squares = turned * turned
        norms = np.sqrt(squares.sum(1, keepdims=True))
        self.longest = float(norms.max(initial=0))
        # leading components, the residual's length, and a share of the length for what rounding may add
        self.bounds = [np.hstack([turned[:, :m], np.sqrt(squares[:, m:].sum(1, keepdims=True)), np.sqrt(SLACK) * (norms + 1)]) for m in steps]


class Best:
    """For the anchors of a block, in each of their windows, the best rows so far."""

    def __init__(self, anchors: Block, most: int, every: bool):
        n = len(anchors.ids)
        self.low = np.full((n, 1), LOWEST) if every else anchors.low
        self.high = np.full((n, 1), np.iinfo(np.int64).max) if every else anchors.high
        self.scores = np.full((n, self.low.shape[1], most), LOWEST)
        self.ids = np.full(self.scores.shape, -1, np.int64)
        self.most, self.found = most, np.zeros(self.low.shape, np.int64)
        self.anchors = anchors.ids

    def thresholds(self) -> np.ndarray:
        """Scores below these can't be among the best in any window of their anchor; a closed window asks for nothing."""
        worst = np.where(self.found == self.most, np.maximum(self.scores[:, :, -1], self.low), self.low).astype(np.float64)
        worst[self.low == LOWEST] = np.where(self.found == self.most, self.scores[:, :, -1], -np.inf)[self.low == LOWEST]
        return np.where(self.low <= self.high, worst, np.inf).min(1)

    def offer(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            inside = (scores >= self.low[at, w]) & (scores <= self.high[at, w])
            inside &= (self.found[at, w] < self.most) | (scores >= self.scores[at, w, -1])
            a, i, s = at[inside], ids[inside], scores[inside]
            if not len(a):
                continue
            touched = np.unique(a)
            known = np.arange(self.most) < self.found[touched, w][:, None]
            a = np.concatenate([a, np.repeat(touched, self.found[touched, w])])
            i = np.concatenate([i, self.ids[touched, w][known]])
            s = np.concatenate([s, self.scores[touched, w][known]])
            order = np.lexsort((-s, i, a))  # once each id, by its best row
            a, i, s = a[order], i[order], s[order]
            once = np.concatenate([[True], (a[1:] != a[:-1]) | (i[1:] != i[:-1])])
            a, i, s = a[once], i[once], s[once]
            order = np.lexsort((i, -s, a))
            a, i, s = a[order], i[order], s[order]
            begins = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            place = np.arange(len(a)) - np.repeat(begins, np.diff([*begins, len(a)]))
            top = place < self.most
            self.scores[a[top], w, place[top]], self.ids[a[top], w, place[top]] = s[top], i[top]
            self.found[touched, w] = np.minimum(np.diff([*begins, len(a)]), self.most)

    def rows(self) -> pa.RecordBatch:
        at, w, k = np.nonzero(np.arange(self.most) < self.found[:, :, None])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.anchors[at], w, self.ids[at, w, k], self.scores[at, w, k])], names=["anchor_id", "slot", "id", "score"])


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of pairs of rows, a slice at a time."""
    return np.concatenate([np.einsum("nd,nd->n", a[i[k : k + 32768]], b[j[k : k + 32768]]) for k in range(0, max(1, len(i)), 32768)])


def scan(anchors: Block, rows: Block, best: Best, same_label: bool) -> None:
    """Offers to ``best`` what a block of rows may add. Slices begin small, so that thresholds are there when they grow."""
    if anchors.longest * rows.longest >= LIMIT:
        raise OverflowError("scores of 2^55 or more")
    exact_floats = anchors.longest * rows.longest < 1 << 52
    begin, size = 0, 32
    while begin < len(rows.ids):
        part = slice(begin, begin + size)
        begin, size = begin + size, min(2 * size, 1024)
        least = best.thresholds()
        upper = anchors.bounds[0] @ rows.bounds[0][part].T
        may = upper >= least[:, None]
        may &= (anchors.labels[:, None] == rows.labels[part]) == same_label
        if same_label:
            may &= anchors.ids[:, None] != rows.ids[part]
        i, j = np.nonzero(may)
        if len(i) > may.size // 8 and exact_floats:  # integers below 2^53 are exact as floats, also in sums
            scores = (anchors.floats @ rows.floats[part].T).astype(np.int64)[i, j]
        else:
            for bound in range(1, len(anchors.bounds)):
                left = np.concatenate([np.einsum("nd,nd->n", anchors.bounds[bound][i[k : k + 32768]], rows.bounds[bound][part][j[k : k + 32768]]) for k in range(0, max(1, len(i)), 32768)]) >= least[i]
                i, j = i[left], j[left]
            scores = products(anchors.ints, rows.ints[part], i, j)
        kept = scores >= least[i]
        best.offer(i[kept], rows.ids[part][j[kept]], scores[kept])


def meet(anchors: DataFrame, rows: DataFrame, axes: np.ndarray, steps: list[int], most: int, same_label: bool) -> DataFrame:
    """(anchor_id, slot, id, score): each task's best rows for its anchors."""
    group = F.col("bucket") if same_label else F.lit(0).cast("long")

    def shares(side: DataFrame, blocks_of_key: int) -> Column:
        """How many keys the blocks of a group are dealt over."""
        counts = side.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()  # BUCKETS rows at most
        return F.coalesce(F.create_map(*[F.lit(x) for r in counts for x in (r["g"], -(-r["n"] // blocks_of_key))])[group] if counts else F.lit(None).cast("int"), F.lit(0))

    ways = {"a": shares(anchors, 8), "r": shares(rows, KEY_BLOCKS)}
    mine = lambda n: F.pmod(F.col("block"), F.greatest(n, F.lit(1)))
    every = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    data = ("ids", "labels", "low", "high", "ints")
    left = anchors.select(group.alias("g"), mine(ways["a"]).cast("int").alias("a"), every(ways["r"]).alias("r"), "block", F.struct(*data).alias("x"))
    right = rows.select(group.alias("g"), every(ways["a"]).alias("a"), mine(ways["r"]).cast("int").alias("r"), F.struct(*data).alias("y"))
    pairs = left.join(right, ["g", "a", "r"]).select("block", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: dict[int, tuple[Block, Best]] = {}
        arrays = lambda x: [x.field(c)[0].as_py() for c in data]
        for batch in batches:
            for k in range(batch.num_rows):
                block, x, y = (batch.column(c).slice(k, 1) for c in range(3))
                number = block[0].as_py()
                if number not in held:
                    if len(held) == 16:
                        yield held.pop(next(iter(held)))[1].rows()
                    anchor = Block(*arrays(x), axes, steps)
                    held[number] = anchor, Best(anchor, most, same_label)
                scan(held[number][0], Block(*arrays(y), axes, steps), held[number][1], same_label)
        for _, best in held.values():
            yield best.rows()

    return pairs.mapInArrow(run, "anchor_id long, slot long, id long, score long")


def best_of(found: DataFrame, most: int) -> DataFrame:
    """(anchor_id, slot, id, score, rank): the best of all tasks. A task gives ``most`` rows for a slot, so no key is large."""
    once = found.groupBy("anchor_id", "slot", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is divisible by ``anchor_every``. For each of an anchor's first POSITIVES rows of its label, the
    first NEGATIVES rows of other labels that score from half to 95 hundredths of what the positive does.
    """
    usable = materialise(integers(rows, id_col, vector_col, F.col("label") if label is None else label), "integers")
    width = usable.agg(F.max(F.size("v"))).first()[0] or 1
    axes, steps = rotation(usable, width)
    all_rows = blocks(usable, width, ROW_BLOCK)
    chosen = usable.where(F.col("vec_id") % anchor_every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    anchors = materialise(chosen.select("vec_id", "x.label", "x.v"), "anchors")

    positives = materialise(best_of(meet(blocks(anchors, width, ANCHOR_BLOCK), all_rows, axes, steps, POSITIVES, True), POSITIVES), "positives")
    # windows of scores, at most POSITIVES of an anchor; an absent one is closed
    of_anchor = positives.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("p"))
    low, high = F.expr(window_sql("-((-p[i]) div 2 - if((-p[i]) % 2 < 0, 1L, 0L))", 1)), F.expr(window_sql("(95 * p[i]) div 100 - if((95 * p[i]) % 100 < 0, 1L, 0L)", 0))
    windows = anchors.join(of_anchor, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", low.alias("low"), high.alias("high"))
    found = best_of(meet(blocks(windows, width, ANCHOR_BLOCK, True), all_rows, axes, steps, NEGATIVES, False), NEGATIVES)
    named = positives.select("anchor_id", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def window_sql(bound: str, absent: int) -> str:
    """The bounds of all positives, in SQL; that of an absent one is ``absent``."""
    return f"transform(sequence(1, {POSITIVES}), i -> coalesce({bound}, {absent}L))"
