"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits. One linear classifier per bit, over hashed byte bigrams and trigrams of
the lower-cased text, predicts that bit; decoding sums the logistic loss of every bit against every codeword and takes
the least. The softmax of the negated losses is the score; a document is flagged ambiguous where the best two
codewords are nearer to each other than a tolerance.

The classifiers are fitted on a bounded sample (``per_language`` documents of each language, expected; drawn by hash),
the prediction reads every whole text. Up to seven languages get the exhaustive code, more get a random code
of at least 10 log2(L) bits chosen for its least distance.

Defined results: null text and text without a letter give ``und``, score 0, not ambiguous; rows with null lang or null
doc_id teach nothing (null doc_id counts as not held out); repeated rows count each; with no language to learn
every document is ``und``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, flat, steps

TRIGRAMS, BIGRAMS = 4096, 1024
SIZE = TRIGRAMS + BIGRAMS
UNKNOWN = "und"
#: Counts of up to so many languages are broadcast; beyond that they are joined by a shuffle.
MOST_LANGUAGES = 10_000


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of n-gram counts, each row of unit length. n-grams stay inside their document."""
    n = len(offsets) - 1
    base = offsets - offsets[0]
    out = np.zeros((n, SIZE), np.float32)
    x = raw.astype(np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(base))
    for width, size, shift in ((3, TRIGRAMS, 0), (2, BIGRAMS, TRIGRAMS)):
        if len(x) < width:
            continue
        inside = doc[: len(x) - width + 1] == doc[width - 1 :]
        code = x[: len(x) - width + 1] * 0x3D + x[1 : len(x) - width + 2] * 0x1F35
        if width == 3:
            code = code + x[2:] * 0x2B1A7
        code = ((code ^ (code >> 9)) * 0x5BD1) >> 4 & (size - 1)
        at = doc[: len(code)][inside].astype(np.int64) * size + code[inside]
        out[:, shift : shift + size] = np.bincount(at, minlength=n * size).reshape(n, size)
    np.sqrt(out, out=out)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norm, 1e-9)[:, None]


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1 bits, any two far apart."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        bits = np.arange(1, 2 ** (n - 1))
        return np.array([[1.0 if i == 0 or not b >> (i - 1) & 1 else -1.0 for b in bits] for i in range(n)], np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    width = max(16, int(np.ceil(10 * np.log2(n))))
    for _ in range(200):
        code = rng.choice(np.array([-1.0, 1.0], np.float32), (n, width))
        apart = (width - code @ code.T) / 2 + width * np.eye(n)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


def fit_bits(x: np.ndarray, labels: np.ndarray, code: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression of all bits at once, with a bias row, by Adam; languages weigh alike."""
    target = code[labels]
    weight = (1 / np.bincount(labels, minlength=len(code))[labels]).astype(np.float32)
    weight /= weight.sum()
    w = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        margin = (x @ w[:-1] + w[-1]) * target
        g = -target / (1 + np.exp(np.clip(margin, -30, 30))) * weight[:, None]
        grad = np.vstack([x.T @ g, g.sum(0, keepdims=True)]) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def decode(margins: np.ndarray, code: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by summed logistic loss, its softmax share, and whether the runner-up is too near."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None, :, :]).sum(2)
    best = loss.argmin(1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    order = np.sort(loss, 1)
    near = (order[:, 1] - order[:, 0] < tolerance) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return best, 1 / share.sum(1), near


class LanguageModel:
    def __init__(self, names: list[str], code: np.ndarray, weights: np.ndarray, tolerance: float):
        self.names, self.code, self.weights, self.tolerance = names, code, weights, tolerance


def fit(docs: DataFrame, per_language: int = 500, tolerance: float = 0.2) -> LanguageModel:
    """Learn from rows (doc_id, text, lang) with a language, at most about ``per_language`` of each.

    The share of a language that is drawn follows from its count, so the sample is bounded at any size.
    """
    known = docs.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    if counts.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES:
        counts = F.broadcast(counts)
    drawn = known.join(counts, "lang").filter(F.expr(f"shiftrightunsigned(xxhash64(doc_id, 11), 11) < {1 << 53}D * {per_language} / n")).select("lang", "text")

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = flat(pc.utf8_lower(batch.column("text")))
        for a, b in steps(offsets, 1 << 20):
            x = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1])
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = sorted(((r["lang"], bytes(r["x"])) for r in arrow_map(drawn, rows, "lang string, x binary").collect()))
    names = sorted({lang for lang, _ in got})
    if not names:
        return LanguageModel([], codewords(0), np.zeros((SIZE + 1, 1), np.float32), tolerance)
    x = np.frombuffer(b"".join(v for _, v in got), np.float16).reshape(len(got), SIZE).astype(np.float32)
    place = {lang: i for i, lang in enumerate(names)}
    code = codewords(len(names))
    return LanguageModel(names, code, fit_bits(x, np.array([place[lang] for lang, _ in got]), code), tolerance)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred, score and ambiguous to all rows and columns of ``docs``; reads only text."""
    names, code, weights, tolerance = model.names, model.code, model.weights, model.tolerance
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = batch.column("text")
        spoken = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        best, score, near = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
        if names and spoken.any():
            raw, offsets = flat(pc.utf8_lower(text))
            for a, b in steps(offsets, 1 << 20):
                for c in range(a, b, 256):
                    d = min(b, c + 256)
                    x = features(raw[offsets[c] : offsets[d]], offsets[c : d + 1])
                    best[c:d], score[c:d], near[c:d] = decode(x @ weights[:-1] + weights[-1], code, tolerance)
            best[~spoken], score[~spoken], near[~spoken] = -1, 0, False
        found = pa.array([UNKNOWN, *names]).take(pa.array(best + 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found, pa.array(score), pa.array(near)], names=[*kept, "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return arrow_map(docs.select(*kept), rows, f"{kinds}, lang_pred string, score double, ambiguous boolean")
