"""Quality of a text by a byte-level convolutional network, in numpy.

The text's UTF-8 bytes are covered by chunks of CHUNK bytes that overlap by half. Learned filters
of WIDTH bytes slide over each chunk; each filter's largest response there goes through tanh; the
mean and the largest over all chunks of the whole document feed one logistic unit.

It is trained on a bounded, repeatable sample (TRAIN_DOCS of each label, those of the smallest
hashes), weighed back to the labels' true shares so that the score is a probability. A training
document counts through BAG chunks, drawn anew from its whole length in each epoch. Training texts
are cut at TRAIN_CHARS; scored texts never are.

A null or empty text is scored as one chunk of padding. Without two labels to learn from, the score
is the share of label 1 (0.5 if there is none). A document labelled twice counts as its larger label.
Rows that repeat get equal scores; other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scored, smallest_by_hash

TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000
WIDTH, FILTERS, SEGMENT = 6, 16, 256
CHUNK = 2 * SEGMENT
BAG, EPOCHS, BATCH, RATE = 8, 10, 64, 0.01
FIELDS = T.StructType([T.StructField("score", T.DoubleType())])
#: Segments whose responses are in memory at once.
AT_ONCE = 1024


@dataclass
class ByteNetwork:
    filters: np.ndarray  # WIDTH, 256, FILTERS
    bias: np.ndarray
    weights: np.ndarray  # of the mean, then of the largest over chunks
    offset: float


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, n: int, chars: int, doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most n documents of either label, each cut at `chars`.

    Of rows that share an id one text is learned from, the first in order; of labels of one id the greater. Null texts are empty.
    """
    known = labels.where(F.col(label).isin(0, 1) & learnable).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("label"))
    known = docs.select(F.col(doc_id).alias("id")).join(known, "id").distinct()
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = smallest_by_hash(known, "label", "id", n)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.substring(F.col(text), 1, chars), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("label", "id").agg(F.min("text").alias("text"))  # n ids a label: at most 2 n rows of `chars` characters, however often an id repeats
    found = sorted(rows.collect(), key=lambda r: (r["label"], r["id"], r["text"]))
    y = np.array([r["label"] for r in found], np.float64)
    weights = np.array([shares[r["label"]] / max(1, (y == r["label"]).sum()) for r in found])
    return [r["text"] for r in found], y, weights / max(1e-12, weights.mean()) if len(weights) else weights


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


class _Adam:
    def __init__(self, *parts: np.ndarray) -> None:
        self.parts, self.mean, self.square, self.turn = parts, [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0

    def step(self, *grads: np.ndarray) -> None:
        self.turn += 1
        for p, m, s, g in zip(self.parts, self.mean, self.square, grads, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**self.turn)) / (np.sqrt(s / (1 - 0.999**self.turn)) + 1e-8)


def train(texts: list[str], y: np.ndarray, weights: np.ndarray, seed: int = 7) -> ByteNetwork:
    rng = np.random.default_rng(seed)
    share = float((y * weights).sum() / weights.sum()) if len(y) else 0.5
    start = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    filters = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
    bias, out, offset = np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.array([start], np.float32)
    if len(set(y.tolist())) < 2:
        return ByteNetwork(filters, bias, np.zeros_like(out), start if len(y) else 0.0)
    raw = [np.append(b, np.zeros(max(0, CHUNK + WIDTH - 1 - len(b)), np.uint8)) for b in map(_raw, texts)]
    adam = _Adam(filters, bias, out, offset)
    window = np.arange(CHUNK + WIDTH - 1)
    for _ in range(EPOCHS):
        order = rng.permutation(len(raw))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            bags = [rng.integers(0, len(raw[i]) - CHUNK - WIDTH + 2, min(BAG, -(-len(raw[i]) // CHUNK))) for i in some]
            sizes = np.array([len(b) for b in bags])
            first = np.cumsum(sizes) - sizes
            chunks = np.concatenate([raw[i][b[:, None] + window] for i, b in zip(some, bags, strict=True)])
            response = sum(filters[j][chunks[:, j : j + CHUNK]] for j in range(WIDTH))
            at = response.argmax(1)  # chunk, filter
            h = np.tanh(np.take_along_axis(response, at[:, None], 1)[:, 0] + bias)
            mean, peak = np.add.reduceat(h, first) / sizes[:, None], np.maximum.reduceat(h, first)
            z = np.hstack([mean, peak]) @ out + offset
            d = (weights[some] * (1 / (1 + np.exp(-z)) - y[some]) / len(some)).astype(np.float32)
            doc = np.repeat(np.arange(len(some)), sizes)
            is_peak = h == peak[doc]
            dh = d[doc, None] * (out[:FILTERS] / sizes[doc][:, None] + out[FILTERS:] * is_peak) * (1 - h * h)
            g = np.zeros_like(filters)
            f = np.broadcast_to(np.arange(FILTERS), at.shape)
            for j in range(WIDTH):
                np.add.at(g[j], (np.take_along_axis(chunks, at + j, 1), f), dh)
            adam.step(g, dh.sum(0), np.hstack([mean, peak]).T @ d, d.sum(keepdims=True))
    return ByteNetwork(filters, bias, out, float(offset[0]))


def predict(net: ByteNetwork, pairs: list[np.ndarray], texts: pa.Array) -> np.ndarray:
    """Scores of whole texts. pairs: for two neighbouring bytes, what the filters give in all."""
    own = [_raw(t) if t else np.empty(0, np.uint8) for t in texts.to_pylist()]
    pad = np.zeros(WIDTH, np.uint8)
    data = np.concatenate([x for b in own for x in (b, pad)]).astype(np.int32)
    code = (data[:-1] << 8) | data[1:]
    lengths = np.array([max(1, len(b)) for b in own])
    begins = np.cumsum([0, *[len(b) + WIDTH for b in own[:-1]]])
    counts = -(-lengths // SEGMENT)
    doc = np.repeat(np.arange(len(own)), counts)
    first = np.cumsum(counts) - counts
    inside = (np.arange(counts.sum()) - first[doc]) * SEGMENT
    starts, ends = begins[doc] + inside, begins[doc] + np.minimum(inside + SEGMENT, lengths[doc])
    peaks = np.empty((len(starts), FILTERS), np.float32)
    for k in range(0, len(starts), AT_ONCE):
        a, b = starts[k : k + AT_ONCE], ends[k : k + AT_ONCE]
        low, high = a[0], b[-1]
        response = pairs[0][code[low:high]]
        for j in range(1, WIDTH // 2):
            response += pairs[j][code[low + 2 * j : high + 2 * j]]
        bounds = np.column_stack([a, b]).ravel() - low
        peaks[k : k + AT_ONCE] = np.maximum.reduceat(np.vstack([response, np.full((1, FILTERS), -np.inf, np.float32)]), bounds, axis=0)[::2]
    # A chunk is two segments; a document of one segment is one chunk.
    last = np.append(doc[1:] != doc[:-1], True)
    following = np.vstack([peaks[1:], peaks[-1:]])
    chunk = np.where(last[:, None], peaks, np.maximum(peaks, following))
    use = ~last | (counts[doc] == 1)
    h = np.tanh(chunk + net.bias)
    n = np.bincount(doc[use], minlength=len(own))
    mean = np.add.reduceat(np.where(use[:, None], h, 0), first) / n[:, None]
    peak = np.maximum.reduceat(np.where(use[:, None], h, -1), first)
    z = np.hstack([mean, peak]).astype(np.float64) @ net.weights + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def quality(docs: DataFrame, net: ByteNetwork, text: str = "text") -> DataFrame:
    """Each document packed as `row`, with its score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    tables: list[np.ndarray] = []

    def score(texts: pa.Array) -> list[pa.Array]:
        model = shared.value
        if not tables:
            tables.extend((model.filters[j][:, None] + model.filters[j + 1][None]).reshape(1 << 16, FILTERS) for j in range(0, WIDTH, 2))
        return [pa.array(predict(model, tables, texts))]

    return scored(docs, text, score, FIELDS)
