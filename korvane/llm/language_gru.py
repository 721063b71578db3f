"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled texts. It labels every
byte of a text; the mean of the labels' probabilities is the document's. A text is read whole, as windows of WINDOW
bytes that are independent of each other, so many windows of many texts take each step together.

Nulls and ties: a null text, and one without a letter, is ``und`` with score 0, as is every text where nothing is
labelled. A null doc_id is not held out. Equal probabilities go to the first language in order. Rows that repeat, other
columns and empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

HIDDEN, WINDOW = 8, 128
#: The training sample: about so many documents of each language, and a slice of so many characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 512
STEPS, BATCH, RATE = 300, 192, 0.02
#: Windows that take a step together.
TOGETHER = 2048
UNKNOWN = "und"

# Weights have a first axis for the direction: 0 reads forwards, 1 backwards. Gates stand in the order update, reset,
# candidate on the last axis.


@dataclass
class Network:
    languages: list[str]
    inputs: np.ndarray  # (2, 256, 3 * HIDDEN)
    hidden: np.ndarray  # (2, HIDDEN, 3 * HIDDEN)
    out: np.ndarray  # (2 * HIDDEN, languages)
    bias: np.ndarray  # (languages,)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden, self.out, self.bias]

    @classmethod
    def start(cls, languages: list[str], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        return cls(languages, draw(2, 256, 3 * HIDDEN), draw(2, HIDDEN, 3 * HIDDEN), draw(2 * HIDDEN, len(languages)), np.zeros(len(languages), np.float32))


def _both_ways(x: np.ndarray) -> np.ndarray:
    """(steps, 2, windows): at each step the bytes that the two directions read."""
    return np.stack([x.T, x.T[::-1]], axis=1)


def forward(net: Network, x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, list]:
    """States (steps, 2, windows, HIDDEN) for bytes x (windows, steps), and what ``backward`` needs.

    A state is 0 where a window has no byte, so padding before the backward direction leaves no trace.
    """
    steps, way = _both_ways(x), _both_ways(valid.astype(np.float32))
    h = np.zeros((2, len(x), HIDDEN), np.float32)
    states, kept = np.empty((len(steps), *h.shape), np.float32), []
    for t, now in enumerate(steps):
        given = np.stack([net.inputs[d][now[d]] for d in (0, 1)])
        past = h @ net.hidden
        gates = 0.5 * np.tanh(0.5 * (given[..., : 2 * HIDDEN] + past[..., : 2 * HIDDEN])) + 0.5
        z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
        n = np.tanh(given[..., 2 * HIDDEN :] + r * past[..., 2 * HIDDEN :])
        kept.append((now, h, z, r, n, past[..., 2 * HIDDEN :], way[t][..., None]))
        h = (n + z * (h - n)) * way[t][..., None]
        states[t] = h
    return states, kept


def _joined(states: np.ndarray) -> np.ndarray:
    """(windows, steps, 2 * HIDDEN): both directions' states of each byte."""
    return np.concatenate([states[:, 0], states[::-1, 1]], axis=-1).transpose(1, 0, 2)


def probabilities(net: Network, states: np.ndarray) -> np.ndarray:
    """(windows, steps, languages)."""
    logits = _joined(states) @ net.out + net.bias
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(net: Network, x: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all bytes, and its gradient by each weight."""
    states, kept = forward(net, x, valid)
    p = probabilities(net, states)
    total = valid.sum()
    right = np.take_along_axis(p, np.broadcast_to(label[:, None, None], (*x.shape, 1)), axis=2)[..., 0]
    loss = float(-(np.log(right + 1e-9) * valid).sum() / total)
    d = p.copy()
    d[np.arange(len(x))[:, None], np.arange(x.shape[1])[None], label[:, None]] -= 1
    d *= (valid / total)[..., None].astype(np.float32)
    joined = _joined(states)
    d_out, d_bias = np.einsum("nth,ntc->hc", joined, d), d.sum(axis=(0, 1))
    d_joined = (d @ net.out.T).transpose(1, 0, 2)
    d_states = np.stack([d_joined[..., :HIDDEN], d_joined[::-1, :, HIDDEN:]], axis=1)
    d_inputs, d_hidden = np.zeros_like(net.inputs), np.zeros_like(net.hidden)
    d_h = np.zeros_like(kept[0][1])
    for t in range(len(kept) - 1, -1, -1):
        now, h, z, r, n, past_n, way = kept[t]
        g = (d_states[t] + d_h) * way
        d_n = g * (1 - z) * (1 - n * n)
        d_z = g * (h - n) * z * (1 - z)
        d_r = d_n * past_n * r * (1 - r)
        d_past = np.concatenate([d_z, d_r, d_n * r], axis=-1)
        d_given = np.concatenate([d_z, d_r, d_n], axis=-1)
        for k in (0, 1):
            np.add.at(d_inputs[k], now[k], d_given[k])
        d_hidden += h.transpose(0, 2, 1) @ d_past
        d_h = g * z + d_past @ net.hidden.transpose(0, 2, 1)
    return loss, [d_inputs, d_hidden, d_out, d_bias]


def train(texts: list[bytes], labels: list[str], seed: int = 0, steps: int = STEPS, window: int = 64) -> Network:
    """Adam over random windows of the texts, each language as often as the others."""
    languages = sorted(set(labels))
    net, rng = Network.start(languages, seed), np.random.default_rng(seed)
    pools = [[np.frombuffer(t, np.uint8) for t, y in zip(texts, labels, strict=True) if y == lang and t] for lang in languages]
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    for step in range(1, steps + 1):
        x, valid = np.zeros((BATCH, window), np.uint8), np.zeros((BATCH, window), bool)
        label = rng.integers(0, len(languages), BATCH)
        for i, y in enumerate(label):
            if pools[y]:
                text = pools[y][rng.integers(len(pools[y]))]
                begin = rng.integers(max(1, len(text) - window + 1))
                piece = text[begin : begin + window]
                x[i, : len(piece)], valid[i, : len(piece)] = piece, True
        if not valid.any():
            break
        _, grads = gradients(net, x, valid, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for w, g, m, v in zip(net.weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _states(net: Network, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """As ``forward``, in place and without what training needs."""
    size = (2, len(x))
    inputs, hidden = net.inputs.copy(), net.hidden.copy()
    inputs[..., : 2 * HIDDEN] *= 0.5
    hidden[..., : 2 * HIDDEN] *= 0.5
    steps, way = _both_ways(x), _both_ways(valid.astype(np.float32))
    padded = ~valid.all()
    h = np.zeros((*size, HIDDEN), np.float32)
    given, past = np.empty((*size, 3 * HIDDEN), np.float32), np.empty((*size, 3 * HIDDEN), np.float32)
    states = np.empty((len(steps), *h.shape), np.float32)
    for t, now in enumerate(steps):
        for d in (0, 1):
            np.take(inputs[d], now[d], axis=0, out=given[d], mode="clip")
        np.matmul(h, hidden, out=past)
        gates = given[..., : 2 * HIDDEN] + past[..., : 2 * HIDDEN]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        n = gates[..., HIDDEN:] * past[..., 2 * HIDDEN :]
        n += given[..., 2 * HIDDEN :]
        np.tanh(n, out=n)
        h -= n
        h *= gates[..., :HIDDEN]
        h += n
        if padded:
            h *= way[t][..., None]
        states[t] = h
    return states


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean over all bytes of each text; zeros for an empty one."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts])
    sums = np.zeros((len(texts), len(net.languages)))
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    valid = np.zeros(len(flat), bool)
    for t, begin in zip(texts, (np.cumsum(counts) - counts) * WINDOW, strict=True):
        flat[begin : begin + len(t)] = np.frombuffer(t, np.uint8)
        valid[begin : begin + len(t)] = True
    x, valid, doc = flat.reshape(-1, WINDOW), valid.reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts)
    for a in range(0, len(x), TOGETHER):
        some = slice(a, a + TOGETHER)
        p = probabilities(net, _states(net, x[some], valid[some]))
        np.add.at(sums, doc[some], np.einsum("ntc,nt->nc", p, valid[some].astype(np.float32)))
    return sums / np.maximum(1, [len(t) for t in texts])[:, None]


# --- Spark ------------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """The network, learned from rows that aren't held out; None if none of them is labelled.

    Only the sample goes to the driver: a row is in it if the hash of its id is below its language's share.
    """
    text, lang, doc_id = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`"), F.col(f"`{id_col}`")
    usable = docs.where(lang.isNotNull() & text.isNotNull() & ~held_out(doc_id)).select(lang.alias("lang"), doc_id.alias("id"), text.alias("text"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    unit = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    begin = F.pmod(F.xxhash64("id", F.lit("slice")), F.greatest(F.length("text") - (SAMPLE_CHARS - 1), F.lit(1))).cast("int") + 1
    rows = usable.where(unit < F.element_at(share, F.col("lang"))).select("lang", "id", F.substr("text", begin, F.lit(SAMPLE_CHARS)).alias("text")).collect()
    rows = sorted(rows, key=lambda r: (str(r["lang"]), str(r["id"]), r["text"]))
    return train([r["text"].encode("utf-8", "surrogatepass") for r in rows], [r["lang"] for r in rows]) if rows else None


def predict(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of those names."""

    @F.pandas_udf("lang string, score double")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if net is not None and lettered.any():
                p = document_probabilities(net, [t.encode("utf-8", "surrogatepass") for t in texts[lettered]])
                lang[lettered] = np.array(net.languages, object)[p.argmax(axis=1)]
                score[lettered] = np.clip(p.max(axis=1), 0.0, 1.0)
            yield pd.DataFrame({"lang": lang, "score": score})

    made = fresh(docs, "_made")
    rows = small_batches(docs).withColumn(made, label(F.col(f"`{text_col}`")))
    return rows.withColumn("lang_pred", F.col(f"{made}.lang")).withColumn("score", F.col(f"{made}.score")).drop(made)


def positions(net: Network, text: str) -> list[str]:
    """The label of every byte of a text."""
    data = text.encode("utf-8", "surrogatepass")
    out = []
    for a in range(0, len(data), WINDOW):
        x = np.frombuffer(data[a : a + WINDOW], np.uint8)[None]
        out += [net.languages[k] for k in probabilities(net, _states(net, x, np.ones(x.shape, bool)))[0].argmax(axis=1)]
    return out
