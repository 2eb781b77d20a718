"""Embedding whitening by a tall-skinny QR decomposition.

Vectors go to the grid of 1/256, x = floor(256 * c), and each different grid vector counts once. Column sums are exact
integers, so rows are centred by a whole and a fractional part without cancellation. Each partition keeps one triangular
factor R of the rows seen so far, the factors are merged ``FAN`` at a time over a tree of shuffles, and the singular value
decomposition of the last R, of as many rows and columns as a vector has entries, gives eigenvalues and eigenvectors; the
covariance matrix itself is never formed. To the driver go the column sums and that one R, both sized by the dimension.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left out; of vectors of
different lengths those of the length with the most different grid vectors stay (ties: the longer); entries outside
+-2^61 on the grid are held at that bound; rows with a null or repeated vec_id each give their rows; components whose
eigenvalue is no more than rounding error are left out, so a table of one different vector gives no rows, as an empty
one does; a deviation that no long can hold is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, cut
from .vectors import finite_rows

SCALE, BOUND = 256, 2.0**61
#: Factors that one step of the tree merges.
FAN = 8
COMPONENTS = 4


@dataclass(frozen=True)
class Whitening:
    """n vectors of ``size`` entries with column sums n * whole + rest; ``axes`` are unit eigenvectors by falling ``values``."""

    n: int
    size: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - S)^2 of each row, None where it does not fit 63 bits."""
        near = ((self.n * self.centred(x)) ** 2).sum(1)
        out: list[int | None] = [None] * len(x)
        for i in np.flatnonzero((near >= 9.2e18) & (near < 9.3e18)):
            exact = sum((self.n * (int(a) - int(m)) - int(r)) ** 2 for a, m, r in zip(x[i], self.whole, self.rest, strict=True))
            out[i] = exact if exact < 1 << 63 else None
        fits = np.flatnonzero(near < 9.2e18)  # then no single square and no product is larger either
        for i, v in zip(fits, ((self.n * (x[fits] - self.whole) - self.rest) ** 2).sum(1).tolist(), strict=True):
            out[i] = v
        return out


def grid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x), -BOUND, BOUND).astype(np.int64)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each grid vector as bytes of the narrowest integers that hold it, so that equal vectors have equal bytes."""
    for batch in batches:
        for _, c in finite_rows(batch.column(0)):
            x = grid(c)
            most = np.abs(x).max(1)
            for kind, low, high in (("<i2", 0, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 63)):
                rows = np.ascontiguousarray(x[(most >= low) & (most < high)].astype(kind))
                if len(rows):
                    keys = pa.array([r.tobytes() for r in rows], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x.shape[1], np.int32)), keys], names=["size", "key"])


def _decoded(batches: Iterator[pa.RecordBatch], size: int, rows: int) -> Iterator[np.ndarray]:
    """Grid vectors of a partition, about ``rows`` at a time."""
    held, n = [], 0
    for batch in batches:
        by_width: dict[int, list[bytes]] = {}
        for k in batch.column(0).to_pylist():
            by_width.setdefault(len(k) // size, []).append(k)
        held += [np.frombuffer(b"".join(ks), f"<i{w}").reshape(-1, size).astype(np.int64) for w, ks in by_width.items()]
        n += batch.num_rows
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def column_sums(keys: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors and each column's exact sum."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for x in _decoded(batches, size, 4096):
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.append(0, high)), pa.array(np.append(n, low))], names=["column", "high", "low"])

    sums = keys.mapInArrow(partial, "column long, high long, low long").groupBy("column").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    by = {r[0]: (int(r[1]) << 32) + int(r[2]) for r in sums.collect()}  # a row a column
    return by[-1], [by[i] for i in range(size)]


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def r_factor(keys: DataFrame, model: Whitening) -> np.ndarray:
    """R of the QR decomposition of all centred rows: one a partition, merged over a tree."""
    size, schema = model.size, "part long, r binary"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for x in _decoded(batches, size, max(1024, 2 * size)):
            r = _stacked([r, model.centred(x)])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def merge(table: pa.Table) -> pa.Table:
        r = np.zeros((0, size))
        for raw in table.column("r").to_pylist():
            r = _stacked([r, np.frombuffer(raw).reshape(-1, size)])
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    factors = cut(keys.mapInArrow(own, schema))
    last = factors.agg(F.max("part")).first()[0]
    while last:
        factors = factors.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInArrow(merge, schema)
        last //= FAN
    return np.frombuffer(factors.first()["r"]).reshape(-1, size)


def identity_error(keys: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(model.values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for x in _decoded(batches, model.size, 4096):
            y = model.whitened(x)
            total += np.vstack((y.T @ y, y.sum(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    sums = {r[0]: r[1] for r in keys.mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v")).collect()}  # k * (k + 1) rows
    total = np.array([sums[i] for i in range(k * (k + 1))]).reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (embedding); None if no component has any variance."""
    batched(rows.sparkSession)
    keys = cut(rows.select("embedding").mapInArrow(_key_rows, "size int, key binary").distinct())
    sizes = keys.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return None
    size = sizes[0]
    keys = keys.filter(F.col("size") == size).select("key")
    n, sums = column_sums(keys, size)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    model = Whitening(n, size, whole, rest, np.zeros(0), np.zeros((0, size)), np.zeros(0))
    r = r_factor(keys, model)
    _, s, axes = np.linalg.svd(r, full_matrices=False)
    real = s[:components] > s[0] * np.finfo(float).eps * max(size, 64)
    if not real.any():
        return None
    k, values = int(real.sum()), s**2 / n
    model = Whitening(n, size, whole, rest, values[:k], axes[:k], values[:k] / values.sum())
    return Whitening(**(model.__dict__ | {"identity_error": identity_error(keys, model)}))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """Per usable row of ``rows`` (vec_id, embedding) and component: its whitened coordinate, with the model's figures."""
    batched(rows.sparkSession)
    base = rows.select("embedding", F.col("vec_id").cast("long").alias("vec_id"))
    if model is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    k = len(model.values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, c in finite_rows(batch.column(0)):
                if c.shape[1] != model.size:
                    continue
                x = grid(c)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                one = lambda v, kind: pa.array(np.tile(v, len(x)), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).take(pa.array(at)).take(each), one(np.arange(1, k + 1), pa.int32()), one([model.n] * k, pa.int64()), pa.array(model.deviation(x), pa.int64()).take(each),
                        pa.array(model.whitened(x).ravel()), one(model.explained, pa.float64()), one([model.identity_error] * k, pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return base.mapInArrow(apply, SCHEMA)
