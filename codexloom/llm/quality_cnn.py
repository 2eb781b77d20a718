"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of ``WIDTH`` bytes slide over overlapping chunks that cover the whole document,
each filter is max-pooled over a chunk, the pooled values are averaged and maximised over the document's chunks, and a
small dense layer combines them into one probability. Backpropagation goes only through each filter's winning window.

Fitting draws a bounded sample (``most`` labelled documents, expected, of each class; by hash) and sees their whole texts;
scoring reads every whole text.

Defined results: null and empty texts are one chunk of padding and are scored like any other; rows without a label or
doc_id teach nothing; of rows that share a doc_id each is scored, and each teaches; an empty table gives an empty
result; with one class or none among the labels every score is that class's share (0.5 with none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, flat

CHUNK, OVERLAP, WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 1024, 64, 8, 4, 8, 48, 24


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks of all documents as rows, padded with byte 0, and each document's first row."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-(size - OVERLAP) // (CHUNK - OVERLAP)))
    first = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(offsets[:-1], count) + (np.arange(first[-1]) - np.repeat(first[:-1], count)) * (CHUNK - OVERLAP)
    end = np.repeat(offsets[1:], count)
    place = at[:, None] + np.arange(CHUNK)
    padded = np.append(raw, np.uint8(0))
    return np.where(place < end[:, None], padded[np.minimum(place, len(raw))], 0).astype(np.uint8), first


class Net:
    """Parameters: embedding, filters, filter bias, dense layer, its bias, output, its bias."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = [make(256, DIM, scale=0.5), make(WIDTH * DIM, FILTERS, scale=0.25), np.zeros(FILTERS, np.float32), make(2 * FILTERS, HIDDEN, scale=0.15), np.zeros(HIDDEN, np.float32), make(HIDDEN, scale=0.3), np.zeros(1, np.float32)]
        self.constant: float | None = None

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(self.p[0][rows])
        n = (CHUNK - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(x, (len(rows), n, WIDTH * DIM), (x.strides[0], STRIDE * DIM * 4, 4), writeable=False)

    def pooled(self, rows: np.ndarray, winners: bool = False):
        out, won = [], []
        for a in range(0, len(rows), 64):
            values = self._windows(rows[a : a + 64]) @ self.p[1]
            out.append(values.max(1))
            if winners:
                won.append(values.argmax(1))
        pooled = np.maximum(np.concatenate(out) + self.p[2], 0)
        return (pooled, np.concatenate(won)) if winners else pooled

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, first = chunks(raw, offsets)
        pooled = self.pooled(rows)
        both = np.hstack([np.add.reduceat(pooled, first[:-1]) / np.diff(first)[:, None], np.maximum.reduceat(pooled, first[:-1])])
        hidden = np.maximum(both @ self.p[3] + self.p[4], 0)
        return 1 / (1 + np.exp(-(hidden @ self.p[5] + self.p[6][0]).clip(-30, 30).astype(np.float64)))

    def gradients(self, rows: np.ndarray, first: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        emb, filters, _, dense, _, out, _ = self.p
        pooled, won = self.pooled(rows, True)
        count = np.diff(first)
        doc = np.repeat(np.arange(len(count)), count)
        mean, top = np.add.reduceat(pooled, first[:-1]) / count[:, None], np.maximum.reduceat(pooled, first[:-1])
        both = np.hstack([mean, top])
        hidden = np.maximum(both @ dense + self.p[4], 0)
        share = 1 / (1 + np.exp(-(hidden @ out + self.p[6][0]).clip(-30, 30)))
        d = ((share - target) * weight).astype(np.float32)
        d_hidden = np.outer(d, out) * (hidden > 0)
        d_both = d_hidden @ dense.T
        best = pooled == top[doc]  # a window in the overlap wins in two chunks and counts once
        d_pool = d_both[doc, :FILTERS] / count[doc, None] + d_both[doc, FILTERS:] * best / np.add.reduceat(best, first[:-1], dtype=np.int64)[doc]
        d_pool *= pooled > 0
        # Windows that won: (chunks, filters, WIDTH) bytes.
        taken = rows[np.arange(len(rows))[:, None, None], won[:, :, None] * STRIDE + np.arange(WIDTH)]
        seen = emb[taken].reshape(len(rows), FILTERS, WIDTH * DIM)
        g_filters = np.einsum("cf,cfw->wf", d_pool, seen)
        g_seen = (d_pool[:, :, None] * filters.T[None]).reshape(-1, DIM)
        g_emb = np.stack([np.bincount(taken.ravel(), g_seen[:, j], 256) for j in range(DIM)], 1).astype(np.float32)
        return [g_emb, g_filters, d_pool.sum(0), both.T @ d_hidden, d_hidden.sum(0), hidden.T @ d, d.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, batches: int = 800, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> Net:
    """Adam over shuffled batches, at least ``batches`` of them; classes weigh alike in the loss."""
    net, share = Net(), labels.mean() if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        net.constant = float(share)
        return net
    rng, t = np.random.default_rng(seed), 0
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    m, v = [np.zeros_like(x) for x in net.p], [np.zeros_like(x) for x in net.p]
    per_pass = -(-len(texts) // batch)
    passes = -(-batches // per_pass)
    total = passes * per_pass
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            raw = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
            rows, first = chunks(raw, np.concatenate(([0], np.cumsum([len(texts[i]) for i in own]))))
            grads, t = net.gradients(rows, first, labels[own], weight[own] / len(own)), t + 1
            step = rate * 0.5 * (1 + np.cos(np.pi * t / total))
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, most: int = 1000, label: str = "quality") -> Net:
    """Learn ``label`` (0/1) of ``labels`` (doc_id, label) from ``docs`` (doc_id, text), about ``most`` of each class."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for y, n in counts.items():
        rate = F.when(F.col("_y") == y, F.lit(most / n)).otherwise(rate)
    drawn = known.filter(F.expr(f"shiftrightunsigned(xxhash64(doc_id, 5), 11) / {1 << 53}D") < rate)
    # The draw is bounded by ``most``, so it goes to the texts, not the texts to it.
    got = sorted((r["doc_id"], r["_y"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").collect())
    return train([t for *_, t in got], np.array([y for _, y, _ in got], np.float64))


def predict(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, score, predicted; reads only text."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = flat(batch.column("text"))
        score = np.full(batch.num_rows, net.constant if net.constant is not None else 0.0)
        if net.constant is None:
            a = 0
            while a < batch.num_rows:  # about 256 chunks at once, or one document
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + 256 * (CHUNK - OVERLAP), side="right")) - 1)
                b = min(b, batch.num_rows, a + 256)
                score[a:b] = net.score(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                a = b
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, score double, predicted int")
