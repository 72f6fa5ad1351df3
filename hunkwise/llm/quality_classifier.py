"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes; a byte of which the next few repeat bytes just before is a symbol
of its own, because filters cannot compare. Filters slide over the whole text, maxima are
taken in overlapping chunks, and the mean and the maximum over all chunks give one
probability through a linear layer.

The network is trained on a bounded sample of labelled documents, the same number of each
label; scoring is a map over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.common import texts

SYMBOLS = 512
ECHO = 4  # bytes that must repeat
LAGS = range(2, 17)


@dataclass(frozen=True)
class Network:
    """Shape and training. The sample holds at most ``per_label`` documents of a label, each of
    at most ``sample_bytes`` bytes; longer ones are scored whole but not learned from."""

    width: int = 8
    stride: int = 4
    embedding: int = 8
    filters: int = 16
    chunk: int = 256  # windows
    overlap: int = 16
    per_label: int = 1200
    sample_bytes: int = 40_000
    epochs: int = 24
    batch: int = 32
    rate: float = 0.01
    seed: int = 11


def symbols(text: bytes, width: int) -> np.ndarray:
    """Bytes as 0-255, those that begin an echo as 256-511; padded so that every byte is in a window."""
    raw = np.frombuffer(text, np.uint8)
    out = np.zeros(len(raw) + 2 * width, np.int64)
    out[: len(raw)] = raw
    if len(raw) > ECHO:
        grams = np.zeros(len(raw) - ECHO + 1, np.uint32)
        for k in range(ECHO):
            grams = (grams << np.uint32(8)) | raw[k : len(raw) - ECHO + 1 + k]
        echo = np.zeros(len(grams), bool)
        for lag in LAGS:
            echo[lag:] |= grams[lag:] == grams[:-lag]
        out[: len(grams)] += 256 * echo
    return out


def windows(n_symbols: int, net: Network) -> int:
    return (n_symbols - net.width) // net.stride


class Weights:
    def __init__(self, net: Network):
        rng = np.random.default_rng(net.seed)
        self.net = net
        self.p = {
            "embed": rng.normal(0, 0.3, (SYMBOLS, net.embedding)),
            "conv": rng.normal(0, 0.3, (net.width, net.embedding, net.filters)),
            "bias": np.zeros(net.filters),
            "out": rng.normal(0, 0.3, 2 * net.filters),
            "shift": np.zeros(1),
        }

    def tables(self) -> np.ndarray:
        """(width, symbols, filters): embedding and filter of each place in one look-up."""
        return np.einsum("se,kef->ksf", self.p["embed"], self.p["conv"]).astype(np.float32)

    def chunks(self, s: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(activations of all windows, first window and end of every chunk)."""
        net = self.net
        n = windows(len(s), net)
        act = tables[0][s[: n * net.stride : net.stride]]
        for k in range(1, net.width):
            act += tables[k][s[k : k + n * net.stride : net.stride]]
        first = np.arange(0, max(1, n - net.overlap), net.chunk - net.overlap)
        return act, first, np.minimum(first + net.chunk, n)

    def pooled(self, s: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """(chunks, filters): maxima of the rectified activations in every chunk."""
        act, first, end = self.chunks(s, tables)
        act = np.concatenate([act, act[-1:]])  # so that an end may be an index
        top = np.maximum.reduceat(act, np.stack([first, end], 1).ravel(), axis=0)[::2]
        return np.maximum(top + self.p["bias"].astype(np.float32), 0)

    def logit(self, pooled: np.ndarray) -> float:
        f = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)])
        return float(f @ self.p["out"] + self.p["shift"][0])

    def score(self, text: bytes, tables: np.ndarray) -> float:
        """A whole text, in stretches of whole chunks: memory does not grow with its length."""
        net = self.net
        step = (net.chunk - net.overlap) * net.stride
        stretch = 1000 * step
        total, top, n = np.zeros(net.filters), np.zeros(net.filters), 0
        for at in range(0, max(1, len(text)), stretch):
            pooled = self.pooled(symbols(text[at : at + stretch + net.overlap * net.stride], net.width), tables)
            total, top, n = total + pooled.sum(axis=0), np.maximum(top, pooled.max(axis=0)), n + len(pooled)
        z = float(np.concatenate([total / n, top]) @ self.p["out"] + self.p["shift"][0])
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def train(bodies: list[bytes], labels: list[int], net: Network = Network()) -> Weights:
    """Adam on the logistic loss. Without both labels, the score is their share, or one half."""
    w = Weights(net)
    if len(set(labels)) < 2:
        w.p["out"][:] = 0
        w.p["shift"][:] = 0 if not labels else (3 if labels[0] else -3)
        return w
    rng = np.random.default_rng(net.seed)
    coded = [symbols(b, net.width) for b in bodies]
    y = np.array(labels, float)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.p.items()}
    step, steps = 0, net.epochs * -(-len(y) // net.batch)
    for _ in range(net.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), net.batch):
            grads = _gradient(w, [coded[i] for i in order[at : at + net.batch]], y[order[at : at + net.batch]])
            step += 1
            rate = net.rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _gradient(w: Weights, coded: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    net, p = w.net, w.p
    tables = w.tables()
    g = {k: np.zeros_like(v) for k, v in p.items()}
    at_filter, at_symbols, flow = [], [], []
    for s, label in zip(coded, y, strict=True):
        act, first, end = w.chunks(s, tables)
        best = np.stack([a + act[a:b].argmax(axis=0) for a, b in zip(first, end, strict=True)])  # (chunks, filters)
        raw = np.take_along_axis(act, best, axis=0) + p["bias"]
        pooled = np.maximum(raw, 0)
        f = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)])
        z = f @ p["out"] + p["shift"][0]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(y)
        g["out"] += d * f
        g["shift"] += d
        down = np.broadcast_to(d * p["out"][: net.filters] / len(first), pooled.shape).copy()
        down[pooled.argmax(axis=0), np.arange(net.filters)] += d * p["out"][net.filters :]
        down *= raw > 0
        g["bias"] += down.sum(axis=0)
        c, f_at = np.nonzero(down)
        at_filter.append(f_at)
        flow.append(down[c, f_at])
        at_symbols.append(s[best[c, f_at][:, None] * net.stride + np.arange(net.width)])
    f_at, flow, sym = np.concatenate(at_filter), np.concatenate(flow), np.concatenate(at_symbols)
    for k in range(net.width):
        table = np.zeros((SYMBOLS, net.filters))
        np.add.at(table, (sym[:, k], f_at), flow)
        g["conv"][k] = p["embed"].T @ table
        g["embed"] += table @ p["conv"][k].T
    return g


def labelled_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, net: Network, doc_id: str, text: str, label: str
) -> list[tuple[bytes, int]]:
    """At most ``2 * per_label`` labelled texts, chosen by a hash of the id.

    A document labelled twice counts as the worse; null labels and ids do not count.
    """
    known = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .filter(learn)
    )
    order = F.xxhash64("doc_id")
    parts = [known.filter(F.col("label") == v).orderBy(order).limit(2 * net.per_label) for v in (0, 1)]
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = []
    for part in parts:  # a bounded number of ids
        found = (
            own.filter(F.octet_length("text") <= net.sample_bytes)
            .join(F.broadcast(part), "doc_id")
            .orderBy(order, "text")
            .limit(net.per_label)
        )
        out += [(r["text"].encode("utf-8", "replace"), r["label"]) for r in found.select("text", "label").collect()]
    return out


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        tables = w.tables()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w.score(t, tables) for t in texts(batch.column(1))], pa.float64())],
                names=["doc_id", "score"],
            )

    return run


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    net: Network = Network(),
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; the score is the probability of label 1.

    ``learn``: a condition on ``doc_id`` of the labels that may be learned from. Only bytes of
    the text are inputs. Null and empty texts have the score of an empty text; rows that repeat
    have equal scores; null ids stay null. Without labels every score is one half; with one
    label only, all scores are alike. An empty table gives no rows; other columns are not
    looked at.
    """
    sample = labelled_sample(docs, labels, learn, net, doc_id, text, label)
    weights = train([t for t, _ in sample], [v for _, v in sample], net)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(_scores(shared), "doc_id bigint, score double")
