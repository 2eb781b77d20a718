"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Equal sets form one class at once and go on as one representative. MinHash values
(240, a byte each) are cut into 40 bands of six; representatives that share a band are candidates: a pair at the
threshold 0.8 shares none with probability 5e-6. Candidates are compared 16 values at a time, and a pair is dropped as soon
as the posterior probability (uniform prior, byte collisions counted in) that its similarity reaches the threshold falls below
``TOLERANCE``. What is left joins representatives into clusters; inside a cluster all pairs are pruned the same way and the
rest verified exactly on their shingle sets. No pair is ever a row: a task compares two blocks of rows and emits each row's
number of links and a spanning forest, so a large group costs blocks against blocks.

Shingles are held as 64-bit hashes whose every step is mixed; equal sets are found by 128 bits over them.

Defined results: a text of one to four words is one shingle; null and empty texts have none and link to nothing; rows
with null doc_id get a null class and no links; rows that share a doc_id count as one node whose links are pooled (each
text is compared by its own signature and set); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, batched, cut, documents_in, mix, signed
from .components import components, forest

N, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 40, 6, 16, 1e-6
VALUES = BANDS * ROWS
#: Rows of a block, for candidates of one band and for members of one cluster.
BAND_BLOCK, CLUSTER_BLOCK = 1024, 256
#: Shingles that the exact comparison holds at once; the space of hashes is gone through in as many parts as that takes.
EXACT_PART = 1_000_000


def shingle_sets(words: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document end to end, and each document's first place (and the end)."""
    grams, sets, first = words.windows(n), [], [0]
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            own = np.unique(grams[a : b - n + 1])
        elif b > a:
            own = words.ranges(np.array([a]), np.array([b]))
        else:
            own = grams[:0]
        sets.append(own)
        first.append(first[-1] + len(own))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array(first)


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """VALUES bytes per document: each the low byte of a mixed minimum. Documents must not be empty."""
    factors = np.random.default_rng(99).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(first) - 1, VALUES), np.uint8)
    product = np.empty_like(hashes)
    for j, a in enumerate(factors):
        np.multiply(hashes, a, out=product)
        out[:, j] = mix(np.minimum.reduceat(product, first[:-1])) & np.uint64(255)
    return out


def set_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each document's set."""
    out = []
    for salt in (0, 0x51ED2701):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + np.uint64(salt)), dtype=np.uint64, out=total[1:])
        out.append(total[first[1:]] - total[first[:-1]])
    return out[0], out[1]


def _signature_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    batch = batch.filter(pc.is_valid(batch.column("doc_id")))
    for part, words in documents_in(batch):
        hashes, first = shingle_sets(words)
        size = np.diff(first)
        full = size > 0
        k1, k2 = set_keys(hashes, first)
        sig: list[bytes | None] = [None] * len(size)
        if full.any():
            for i, s in zip(np.flatnonzero(full), signatures(hashes, np.append(first[:-1][full], first[-1])), strict=True):
                sig[i] = s.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, len(size)), pa.array(signed(k1)), pa.array(signed(k2)), pa.array(size), pa.array(sig, pa.binary())], names=["doc_id", "k1", "k2", "n", "sig"])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _band_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sig = _bytes(batch.column("sig"), VALUES).reshape(-1, BANDS, ROWS)
    key = np.zeros(sig.shape[:2], np.int64)
    for r in range(ROWS):
        key = key << 8 | sig[:, :, r]
    key |= np.arange(BANDS, dtype=np.int64) << 48
    rep = np.repeat(batch.column("rep").to_numpy(), BANDS)
    for a in range(0, len(rep), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()[a : a + (1 << 16)]), pa.array(rep[a : a + (1 << 16)])], names=["key", "rep"])


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the fewest matches at which the posterior P(similarity >= threshold) is not below tolerance."""
    s = (np.arange(4000) + 0.5) / 4000
    hit = s + (1 - s) / 256
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(hit) + (n - m) * np.log1p(-hit)
        weight = np.exp(log - log.max(1, keepdims=True))
        out[n] = int(np.argmax(weight[:, s >= threshold].sum(1) / weight.sum(1) >= tolerance))
    return out


def survivors(sig: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Places of the pairs (i, j) that the incremental comparison does not drop."""
    at = np.flatnonzero(np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]))
    found = np.zeros(len(at), np.int32)
    for n, least in least_matches(threshold).items():
        if not len(at):
            break
        found += (sig[i[at], n - STEP : n] == sig[j[at], n - STEP : n]).sum(1, dtype=np.int32)
        keep = found >= least
        at, found = at[keep], found[keep]
    return at


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Whole groups of sorted rows, about ``rows`` at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        last = np.flatnonzero(change)
        if len(last):
            yield table.slice(0, last[-1] + 1)
            held = table.slice(last[-1] + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _group_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


_BLOCK_KEYS = ["key", "lo", "hi"]


def _candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches, _BLOCK_KEYS, 4096):
        group, side = _group_numbers(table, _BLOCK_KEYS), table.column("block").to_numpy()
        cross = table.column("lo").to_numpy() != table.column("hi").to_numpy()
        sig, size, rep = _bytes(table.column("sig").combine_chunks(), VALUES), table.column("n").to_numpy(), table.column("rep").to_numpy()
        left, right, d = [], [], 1
        while d < len(group):
            i = np.flatnonzero(group[:-d] == group[d:])
            if not len(i):
                break
            i = i[~cross[i] | (side[i] != side[i + d])]
            i = i[survivors(sig, size, i, i + d)]
            left.append(i)
            right.append(i + d)
            d += 1
        if left:
            label = forest(len(rep), np.concatenate(left), np.concatenate(right))
            far = np.flatnonzero(label != np.arange(len(rep)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(rep[label[far]])], names=["u", "v"])


def blocked(rows: DataFrame, key: str, count: str, node: str, size: int) -> DataFrame:
    """Deal the rows of each key into blocks of about ``size`` rows, and each block to every pair of blocks it is in."""
    n = f"cast(ceil({count} / {size}) as int)"
    block = F.expr(f"cast(pmod(xxhash64({node}, 3), {n}) as int)")
    out = rows.withColumn("block", block).withColumn("other", F.explode(F.expr(f"sequence(0, {n} - 1)")))
    out = out.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", count)
    return out.repartition(F.col(key), F.col("lo"), F.col("hi")).sortWithinPartitions(key, "lo", "hi", node)


def exact_links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether each pair's Jaccard similarity reaches the threshold, from sorted shingle sets."""
    size = np.array([len(s) for s in sets])
    if not len(i):
        return np.zeros(0, bool)
    parts = -(-int(size.sum()) // EXACT_PART)
    bounds = [np.uint64(p * (1 << 64) // parts) for p in range(1, parts)]
    cuts = np.array([[0, *np.searchsorted(x, bounds), len(x)] for x in sets])
    if len(i) * 400 > len(sets) ** 2:  # many pairs: shared counts of all rows at once
        shared = np.zeros((len(sets), len(sets)), np.float64)
        for p in range(parts):
            own = [x[a:b] for x, a, b in zip(sets, cuts[:, p], cuts[:, p + 1], strict=True)]
            flat, place = np.unique(np.concatenate(own), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), cuts[:, p + 1] - cuts[:, p])
            order = np.argsort(place, kind="stable")
            owner, place = owner[order], place[order]
            for a in range(0, len(flat), 8192):
                x, y = np.searchsorted(place, (a, a + 8192))
                m = np.zeros((len(sets), min(8192, len(flat) - a)), np.float32)
                m[owner[x:y], place[x:y] - a] = 1
                shared += m @ m.T
        both = shared[i, j].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    # both / (|A| + |B| - both) >= threshold, in integers of millionths
    return both * 1_000_000 >= round(threshold * 1_000_000) * (size[i] + size[j] - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: spanning forest of links; u, null: its links in this pair of blocks, by copies and by sets."""
    for held in _groups(batches, ["root", "lo", "hi"], 1):
        group = _group_numbers(held, ["root", "lo", "hi"])
        ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            table = held.slice(a, b - a).combine_chunks()
            who, key = table.column("node").to_numpy(), table.column("k1").to_numpy()
            _, one = np.unique(np.stack((who, key)), axis=1, return_index=True)
            table = table.take(pa.array(np.sort(one)))  # repeated rows of one doc_id and text
            node, copies, side = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
            sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
            sig, size = _bytes(table.column("sig").combine_chunks(), VALUES), table.column("n").to_numpy()
            i, j = np.triu_indices(len(node), 1)
            if table.column("lo")[0] != table.column("hi")[0]:
                apart = side[i] != side[j]
                i, j = i[apart], j[apart]
            at = survivors(sig, size, i, j)
            i, j = i[at], j[at]
            linked = exact_links(sets, i, j)
            i, j = i[linked], j[linked]
            links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            texts = np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
            label = forest(len(node), i, j)
            far, some = np.flatnonzero(label != np.arange(len(node))), np.flatnonzero(texts)
            u, v = np.concatenate((node[far], node[some])), pa.array([*node[label[far]].tolist(), *[None] * len(some)], pa.int64())
            zero = np.zeros(len(far), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.concatenate((zero, links[some].astype(np.int64)))), pa.array(np.concatenate((zero, texts[some])))], names=["u", "v", "links", "texts"])


def _set_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Replaces text by its sorted shingle hashes; of rows that share a doc_id, those whose set is the node's."""
    at = batch.schema.get_field_index("text")
    wanted = batch.column("k1").to_numpy()
    for part, words in documents_in(batch):
        hashes, first = shingle_sets(words)
        own = np.flatnonzero(signed(set_keys(hashes, first)[0]) == wanted[part])
        rows = batch.slice(part.start, part.stop - part.start).take(pa.array(own))
        yield rows.set_column(at, "hashes", pa.array([hashes[first[i] : first[i + 1]].tobytes() for i in own], pa.binary()))


def similarity_classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_set_links.

    class_id is the smallest doc_id that a chain of links reaches; n_links counts other documents of similarity
    0.8 or more, copies among them; n_set_links counts the different shingle sets among those.
    """
    batched(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed_rows = cut(arrow_map(base, _signature_rows, "doc_id long, k1 long, k2 long, n long, sig binary"))
    reps = signed_rows.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = cut(reps)
    slim = arrow_map(reps.select("rep", "sig"), _band_rows, "key long, rep long")
    shared = slim.groupBy("key").agg(F.count("*").alias("_count")).filter("_count > 1")
    meeting = slim.join(shared, "key").join(reps.select("rep", "n", "sig"), "rep")
    edges = blocked(meeting, "key", "_count", "rep", BAND_BLOCK).mapInArrow(_candidate_edges, "u long, v long")
    clusters = cut(components(edges.distinct()))
    sizes = clusters.groupBy("root").agg(F.count("*").alias("_count"))
    members = clusters.join(sizes, "root").join(reps.select(F.col("rep").alias("node"), "k1", "n", "sig", "copies"), "node")
    texts = base.join(members, base.doc_id == members.node).drop("doc_id")
    kinds = "text binary, node long, root long, _count long, k1 long, n long, sig binary, copies long"
    sets = arrow_map(texts.select("text", "node", "root", "_count", "k1", "n", "sig", "copies"), _set_rows, kinds.replace("text", "hashes", 1))
    links = cut(blocked(sets, "root", "_count", "node", CLUSTER_BLOCK).mapInArrow(_verified, "u long, v long, links long, texts long"))
    classes = components(links.filter("v is not null").select("u", "v"))
    counted = links.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    found = reps.select("k1", "k2", "n", "rep", "copies").join(counted, "rep", "left").join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left")
    out = signed_rows.select("doc_id", "k1", "k2", "n").join(found, ["k1", "k2", "n"], "left")
    out = out.select("doc_id", F.coalesce("root", "rep", "doc_id").alias("class_id"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_set_links"))
    lost = base.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_set_links"))
    return out.unionByName(lost)
