"""Exact range join of embeddings by cosine, as a metric join with pivots.

Unit vectors are compared by their distance, which cosine 0.98 bounds by r = 0.2, so the triangle inequality holds. Vectors
of a label go to the cell of their nearest pivot; a vector is copied to each lower cell whose side of the bisecting plane
lies within r and whose own vectors reach out to it (its distance to that pivot less r). So each pair within r meets in one
cell, and cells join by themselves. Pivots are a hash sample of crowded labels, at most about 2 * ``PIVOTS``, thinned to
distances above r, and each moves once to the mean of the vectors within r, the middle of a group of near copies.

Vectors within r / 2 of their pivot are its core: they all link to each other, so they are counted and joined to the
smallest of them without being compared, and only vectors within 1.5 r of the pivot are compared with them. Cells of more
rows than a block are joined block against block. No pair is ever a row: a task gives each vector's number of links and
a spanning forest.

How much is copied depends on the vectors: clusters cost about a row each, while directions without any structure lie
within r of about a quarter of all bisecting planes (64 entries), whatever the pivots are; then this is a join of all
blocks, still exact.

Defined results: null labels, null vectors, zero vectors and vectors with null or non-finite entries link with nothing, and
vectors of different lengths never link; equal vectors of a label are one node that carries its number of copies; rows with a repeated
vec_id are vectors of their own; a row with null vec_id has its links, counts in those of others and is not kept, and a
component without any vec_id has a null component_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, cut
from .components import components, forest
from .vectors import finite_rows, unit

THRESHOLD = 0.98
#: Vectors of a label that one cell may hold before a label gets more pivots, and the size of the whole pivot table.
CELL, PIVOTS = 1024, 16384
#: Rows and numbers of a block.
BLOCK, BLOCK_NUMBERS = 4096, 1 << 20
#: Distances that a task holds at once.
STEP = 1 << 20
#: Cells, labels or components up to which their table is broadcast.
FEW = 100_000
#: Distances by way of cosines are right to this.
SLACK = 1e-6
CORE, NEAR, FAR, COPY_NEAR, COPY = range(5)  # kinds of rows in a cell

Pivots = dict[str, np.ndarray]


def distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (u @ pivots.T)))


def radius(threshold: float) -> float:
    return float(np.sqrt(2 - 2 * threshold))


def small(table: DataFrame) -> DataFrame:
    """Broadcast once it is counted and small; else it is joined by a shuffle that may split hot keys."""
    table = cut(table)
    return F.broadcast(table) if table.count() <= FEW else table


def nodes_of(rows: DataFrame) -> DataFrame:
    """Each different usable vector of a label once: node, space (length and label), embedding, copies, least vec_id."""
    usable = rows.filter("label is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    space = F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string"))
    nodes = usable.withColumn("space", space).groupBy("space", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return cut(nodes.withColumn("node", F.monotonically_increasing_id()))


def _of_space(batch: pa.RecordBatch, pivots: Pivots) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(space, places, unit vectors) of the rows of a batch, by space, in steps of about a million distances."""
    space = batch.column("space").dictionary_encode()
    names, code = space.dictionary.to_pylist(), space.indices.to_numpy()
    for at, x in finite_rows(batch.column("embedding")):
        u, own = unit(x), code[at]
        for c in np.unique(own):
            here = np.flatnonzero(own == c)
            step = max(1, STEP // len(pivots.get(names[c], "1")))
            for a in range(0, len(here), step):
                yield names[c], at[here[a : a + step]], u[here[a : a + step]]


def thinned(u: np.ndarray, r: float) -> np.ndarray:
    """The rows that are further than r from each row kept before them."""
    keep = np.ones(len(u), bool)
    for i in range(len(u)):
        if keep[i]:
            keep[i + 1 :] &= distances(u[i : i + 1], u[i + 1 :])[0] > r
    return u[keep]


def choose_pivots(nodes: DataFrame, r: float, cell: int, most: int) -> Pivots:
    """Unit pivots of each space of more than a cell's vectors, thinned to distances above r and moved to the middle of what is near."""
    sizes = cut(nodes.groupBy("space").agg(F.count("*").alias("n")))
    cell = max(cell, (sizes.agg(F.sum("n")).first()[0] or 0) // most)
    crowded = sizes.filter(F.col("n") > cell)  # no more than n / cell spaces, and about 2 n / cell pivots
    drawn = nodes.join(F.broadcast(crowded), "space").filter(F.pmod(F.xxhash64("embedding", F.lit(7)), F.lit(1 << 53)) < F.ceil(F.col("n") / cell) / F.col("n") * (1 << 53))
    found: dict[str, list[list[float]]] = {}
    for row in drawn.select("space", "embedding").orderBy("space", F.xxhash64("embedding", F.lit(11)), "embedding").toLocalIterator():
        found.setdefault(row["space"], []).append(row["embedding"])
    pivots = {s: thinned(unit(np.array(p, float)), r) for s, p in found.items()}
    if not pivots:
        return pivots

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for space, _, u in _of_space(batch, pivots):
                d = distances(u, pivots[space])
                home = d.argmin(1)
                close = d[np.arange(len(u)), home] <= r
                for c in np.unique(home[close]):
                    sums[space, int(c)] = sums.get((space, int(c)), 0) + u[close & (home == c)].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["space", "cell", "total"])

    moved = _crowded(nodes, pivots).mapInArrow(near, "space string, cell int, total array<double>")
    moved = moved.select("space", "cell", F.posexplode("total").alias("i", "v")).groupBy("space", "cell", "i").agg(F.sum("v").alias("v"))
    totals: dict[tuple[str, int], np.ndarray] = {}
    for row in moved.toLocalIterator():  # no more rows than the pivots have entries
        totals.setdefault((row["space"], row["cell"]), np.zeros(pivots[row["space"]].shape[1]))[row["i"]] = row["v"]
    for (space, c), total in totals.items():
        if np.linalg.norm(total) > 0:
            pivots[space][c] = unit(total[None])[0]
    return pivots


def _crowded(nodes: DataFrame, pivots: Pivots) -> DataFrame:
    spaces = nodes.sparkSession.createDataFrame([(s,) for s in pivots], "space string")
    return nodes.join(F.broadcast(spaces), "space").select("space", "embedding")


def reach(nodes: DataFrame, pivots: Pivots) -> Pivots:
    """How far the vectors of each cell are from their pivot at most."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = {s: np.full(len(p), -1.0) for s, p in pivots.items()}
        for batch in batches:
            for space, _, u in _of_space(batch, pivots):
                d = distances(u, pivots[space])
                home = d.argmin(1)
                np.maximum.at(far[space], home, d[np.arange(len(u)), home])
        rows = [(s, c, v) for s, x in far.items() for c, v in enumerate(x.tolist()) if v >= 0]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["space", "cell", "far"])

    out = {s: np.full(len(p), -1.0) for s, p in pivots.items()}
    if pivots:
        for row in _crowded(nodes, pivots).mapInArrow(most, "space string, cell long, far double").groupBy("space", "cell").agg(F.max("far").alias("far")).toLocalIterator():
            out[row["space"]][row["cell"]] = row["far"]  # a row a pivot
    return out


def cells(nodes: DataFrame, pivots: Pivots, far: Pivots, r: float) -> DataFrame:
    """The rows of ``nodes`` with the cell of their nearest pivot, and their copies at lower cells' borders: cell, kind."""
    spans = {s: distances(p, p) for s, p in pivots.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, cell, kind = [], [], []
            for space, at, u in _of_space(batch, pivots):
                if space not in pivots:  # one cell, without a pivot
                    place, cell, kind = [*place, at], [*cell, np.zeros(len(at), np.int64)], [*kind, np.full(len(at), FAR)]
                    continue
                d, every = distances(u, pivots[space]), np.arange(len(u))
                home = d.argmin(1)
                own = d[every, home]
                place.append(at)
                cell.append(home)
                kind.append(np.where(own <= r / 2 - SLACK, CORE, np.where(own <= 1.5 * r + SLACK, NEAR, FAR)))
                plane = (d**2 - own[:, None] ** 2) / np.maximum(2 * spans[space][home], SLACK)
                copy = (plane <= r + SLACK) & (d <= far[space] + r + SLACK) & (np.arange(d.shape[1]) < home[:, None])
                i, c = np.nonzero(copy)
                place.append(at[i])
                cell.append(c)
                kind.append(np.where(d[i, c] <= 1.5 * r + SLACK, COPY_NEAR, COPY))
            if place:
                rows = batch.select(["space", "node", "copies", "embedding"]).take(pa.array(np.concatenate(place)))
                for a in range(0, rows.num_rows, 4096):
                    part = rows.slice(a, 4096)
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.concatenate(x)[a : a + 4096], pa.int32()) for x in (cell, kind))], names=["space", "node", "copies", "embedding", "cell", "kind"])

    kinds = dict(nodes.dtypes)
    return nodes.select("space", "node", "copies", "embedding").mapInArrow(deal, f"space string, node long, copies long, embedding {kinds['embedding']}, cell int, kind int")


def dealt_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row once for every block it is to be compared with: lo, hi name the pair of blocks, own the row's.

    Core meets what is near it, a cell's own vectors meet each other and the copies from other cells.
    """
    size = f"greatest(64, least({block}, {BLOCK_NUMBERS} div size(embedding)))"
    rows = rows.withColumn("_size", F.expr(size))
    counts = small(rows.groupBy("space", "cell").agg(*(F.ceil(F.count(F.when(F.col("kind") == k, 1)) / F.max("_size")).cast("int").alias(f"_n{k}") for k in range(5))))
    blocks = lambda *ks: ", ".join(f"transform(filter(sequence(0, _n{k}), b -> b < _n{k}), b -> {k} * 268435456 + b)" for k in ks)
    partners = {CORE: blocks(NEAR, COPY_NEAR), NEAR: blocks(CORE, NEAR, FAR, COPY_NEAR, COPY), FAR: blocks(NEAR, FAR, COPY_NEAR, COPY), COPY_NEAR: blocks(CORE, NEAR, FAR), COPY: blocks(NEAR, FAR)}
    chosen = "case kind " + " ".join(f"when {k} then concat({p})" for k, p in partners.items()) + " end"
    own = "kind * 268435456 + cast(pmod(xxhash64(node, 5), case kind " + " ".join(f"when {k} then _n{k}" for k in range(5)) + " end) as int)"
    out = rows.join(counts, ["space", "cell"]).withColumn("own", F.expr(own)).withColumn("_other", F.explode(F.expr(chosen)))
    return out.select("space", "cell", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"), "own", "node", "copies", "embedding")


def linked(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b have a cosine of at least the threshold; next to it the division decides, not the rounding of unit vectors."""
    cosine = ua @ ub.T
    out = cosine >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12), strict=True):
        x, y = a[i] / np.abs(a[i]).max(), b[j] / np.abs(b[j]).max()
        out[i, j] = (x @ y) / np.sqrt((x @ x) * (y @ y)) >= threshold
    return out


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, node, copies = (table.column(c).to_numpy() for c in ("own", "node", "copies"))
        x = np.zeros((len(own), 0))
        for _, x in finite_rows(table.column("embedding").chunk(0)):  # all of one length
            pass
        u, n = unit(x), len(own)
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        links, label = np.zeros(n), np.arange(n)
        for s in range(0, len(left), 256):
            at = left[s : s + 256]
            hit = linked(x[at], x[right], u[at], u[right], threshold)
            if lo == hi:
                hit &= right > at[:, None]
            links[at] += hit @ copies[right].astype(float)
            links[right] += copies[at].astype(float) @ hit
            i, j = np.nonzero(hit)
            old = np.flatnonzero(label != np.arange(n))
            label = forest(n, np.concatenate((at[i], old)), np.concatenate((right[j], label[old])))
        far, some = np.flatnonzero(label != np.arange(n)), np.flatnonzero(links)
        v = pa.array([*node[label[far]].tolist(), *[None] * len(some)], pa.int64())
        return pa.table({"u": np.concatenate((node[far], node[some])), "v": v, "links": np.concatenate((np.zeros(len(far), np.int64), links[some].astype(np.int64)))})

    return compare


def link_rows(nodes: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """u, v: a spanning forest of the links of ``nodes``; u, null, links: parts of each node's number of linked rows."""
    r = radius(threshold)
    table = choose_pivots(nodes, r, cell, pivots)
    rows = cut(cells(nodes, table, reach(nodes, table), r))
    pairs = dealt_blocks(rows, block).groupBy("space", "cell", "lo", "hi").applyInArrow(_compare(threshold), "u long, v long, links long")
    core = rows.filter(F.col("kind") == CORE)
    whole = small(core.groupBy("space", "cell").agg(F.sum("copies").alias("_all"), F.min("node").alias("_first"), F.count("*").alias("_nodes")).filter("_nodes > 1"))
    settled = core.join(whole, ["space", "cell"])
    counts = settled.select(F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), (F.col("_all") - F.col("copies")).alias("links"))
    edges = settled.filter("node <> _first").select(F.col("node").alias("u"), F.col("_first").alias("v"), F.lit(0).cast("long").alias("links"))
    return cut(pairs.unionByName(counts).unionByName(edges))


def range_join(rows: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    batched(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    nodes = nodes_of(rows)
    links = link_rows(nodes, threshold, cell, pivots, block)
    counts = links.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = cut(components(links.filter("v is not null").select("u", "v")))
    least = roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    members = roots.join(least, "root").select("node", "component")
    found = nodes.join(counts, "node", "left").join(members, "node", "left")
    found = found.select(F.col("space").alias("_space"), F.col("embedding").alias("_vector"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component"))
    space = F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string"))
    out = rows.withColumn("_own", F.when(F.col("label").isNotNull(), space)).join(found, (F.col("_own") == F.col("_space")) & (F.col("embedding") == F.col("_vector")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
