"""Connected components: contraction inside partitions, then alternating large-star and small-star rounds between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .common import cut

#: Edges (16 bytes each) that one task contracts at once.
PART_EDGES = 1_000_000


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each of n rows' smallest connected row."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (before == label).all():
            break
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition to a forest of stars, whose centres are their smallest nodes."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        label = forest(len(nodes), at[: len(u)], at[len(u) :])
        far = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["u", "v"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); the root is the component's smallest node.

    Edges that fit one partition are done when that is contracted. Else each round at least halves the distances to the
    roots, and the loop ends when a round changes nothing. Self-loops and rows with a null end are ignored; no edges
    give no rows.
    """
    importable(edges.sparkSession)
    edges = cut(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v"))
    parts = max(1, -(-edges.count() // part_edges))
    edges = cut(edges.coalesce(parts).mapInArrow(_contract, "u long, v long"))
    seen = None
    for _ in range(rounds if parts > 1 else 0):
        edges = cut(_stars(_stars(edges, True), False))
        mark = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark == seen:
            break
        seen = mark
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
