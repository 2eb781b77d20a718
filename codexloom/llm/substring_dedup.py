"""Substring dedup by De Bruijn compaction of token k-mers.

Edges of the graph are the k-word windows (k = 50). The graph is held in the compacted, minimiser-binned form:
consecutive windows of a document with the same minimiser (the least-hashed 16-word run inside the window)
form one path row, binned by that minimiser, so equal windows of any two documents always share a bin.

1. A bin that only one document touches cannot hold a repeat and goes (a window over the bin).
2. A bin whose paths all carry one label is nonbranching: the same window brings the bin's first path to
   each path, which settles the whole path at once.
3. In branching bins, equal labels compact onto their first path by a second window; only the first
   path of each label is opened, into runs of edges that end where an edge's own hash says so, about every eighth.
   Near copies share all runs but those about their changes, so runs compact by label once more, and only the
   first run of each label is opened into single edges, which a last window compares. A repeated word's equal
   edges in a row are one edge with their number. A line that a document repeats has few different edges, each of
   which is a run of its own; equal runs of a document are one row with their places.
4. The surviving spans carry their source's coordinates (document, first word). A span's words are equal to the source's
   under two hashes of independent salts, each made from the words at those coordinates, 128 bits; the words
   themselves do not travel. Spans go back to the text, where their words are removed.

Defined results: null text has no words; null doc_id rows are returned unchanged and are no source for
others; rows that share a doc_id are never each other's source, and are told apart by 128 bits of their text's SHA-256;
texts of fewer than k words have no window; an empty table gives an empty result; a kept column that carries the name
of a result is replaced by it; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, arrow_map, cut, documents_in, signed

K, MINIMISER, SALT = 50, 16, 0x6A09E667F3BCC909
#: Repeated doc_ids up to which they are broadcast.
MOST_REPEATED = 100_000
_LOW = np.uint64((1 << 24) - 1)
#: A run of edges begins at an edge whose hash has none of these bits.
_EIGHTH = 7


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def paths(words: Words, k: int, m: int) -> dict[str, np.ndarray]:
    """Maximal runs of windows with one minimiser: document, first window (in the step), count, bin, label and its check."""
    n = len(words.hashes)
    none = np.zeros(0, np.int64)
    if n < k:
        return {"doc": none, "at": none, "n": none, "bin": none.astype(np.uint64), "label": none.astype(np.uint64), "check": none.astype(np.uint64)}
    grams = words.windows(m)
    place = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min((grams & ~_LOW) | (place & _LOW), k - m + 1)  # ties: the leftmost
    start = np.arange(n - k + 1)
    anchor = start + ((least - start.astype(np.uint64)) & _LOW).astype(np.int64)
    owner = words.owner()
    inside = owner[: n - k + 1] == owner[k - 1 :]
    start, anchor = start[inside], anchor[inside]
    if not len(start):
        return {"doc": none, "at": none, "n": none, "bin": none.astype(np.uint64), "label": none.astype(np.uint64), "check": none.astype(np.uint64)}
    least = grams[anchor]  # by value: a repeated word's windows are one path, though each has an anchor of its own
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    at = start[first]
    return {"doc": owner[at], "at": at, "n": count, "bin": least[first], "label": words.ranges(at, at + count + k - 1), "check": words.ranges(at, at + count + k - 1, SALT)}


def _path_rows(k: int, m: int):
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pc.is_valid(batch.column("doc_id")))
        ids, marks = batch.column("doc_id").to_numpy(), batch.column("_t")
        for part, words in documents_in(batch):
            p = paths(words, k, m)
            doc = p["doc"] + part.start
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (signed(p["bin"]), signed(p["label"]), signed(p["check"]), ids[doc])), marks.take(pa.array(doc)), *map(pa.array, ((p["at"] - words.first[p["doc"]]).astype(np.int32), p["n"].astype(np.int32)))],
                names=["bin", "label", "check", "doc_id", "_t", "at", "n"],
            )

    return rows


def _again_within(k: int, edge: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each edge, in order of start, has an equal one of its document at most k words away."""
    order = np.argsort(edge, kind="stable")
    e, s, d = edge[order], start[order], doc[order]
    near = (e[1:] == e[:-1]) & (d[1:] == d[:-1]) & (s[1:] - s[:-1] <= k)
    out = np.zeros(len(edge), bool)
    out[order[1:][near]] = out[order[:-1][near]] = True
    return out


def _run_rows(k: int, m: int):
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, marks = batch.column("doc_id").to_numpy(), batch.column("_t")
        opened = batch.column("opened")
        where = np.repeat(np.arange(len(opened)), opened.value_lengths().to_numpy())
        wanted = opened.flatten().to_numpy() >> 1
        later = opened.flatten().to_numpy() & 1
        for part, words in documents_in(batch):
            p = paths(words, k, m)
            here = (where >= part.start) & (where < part.stop)
            at = words.first[where[here] - part.start] + wanted[here]
            pick = np.flatnonzero(np.isin(p["at"], at))
            probe = np.isin(p["at"][pick], at[later[here] == 1])
            count = p["n"][pick]
            start = np.repeat(p["at"][pick] - np.cumsum(count) + count, count) + np.arange(count.sum())
            doc, probe = np.repeat(p["doc"][pick], count), np.repeat(probe, count)
            edge, check = words.ranges(start, start + k), words.ranges(start, start + k, SALT)
            new = np.ones(len(start), bool)
            if len(start):
                new[1:] = (edge[1:] != edge[:-1]) | (check[1:] != check[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1]) | (probe[1:] != probe[:-1])
            one = np.flatnonzero(new)
            run = np.diff(np.append(one, len(start)))
            path = np.repeat(np.arange(len(count)), count)[one]
            head = (edge[one] & np.uint64(_EIGHTH)) == 0
            head[:1] = True
            head[1:] |= (path[1:] != path[:-1]) | (start[one[1:]] != start[one[:-1]] + run[:-1])
            again = _again_within(k, edge[one], start[one], doc[one])
            head |= again
            head[1:] |= again[:-1]
            lead = np.flatnonzero(head)
            bounds = np.append(lead, len(one))
            upto = np.concatenate(([0], np.cumsum(run)))
            n = upto[bounds[1:]] - upto[bounds[:-1]]
            begin, own, probe = start[one[lead]], doc[one[lead]], probe[one[lead]]
            after = (start[one] - np.repeat(begin, np.diff(bounds))).astype(np.int32)
            edges = pa.StructArray.from_arrays([*map(pa.array, (signed(edge[one]), signed(check[one]), after, run.astype(np.int32)))], ["edge", "check", "after", "n"])
            edges = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), edges)
            label, label_check = words.ranges(begin, begin + n + k - 1), words.ranges(begin, begin + n + k - 1, SALT)
            # Equal runs of a document are one row.
            order = np.lexsort((probe, label_check, label, own))
            differ = np.ones(len(order), bool)
            differ[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (own, label, label_check, probe)], axis=0)
            first = np.flatnonzero(differ)
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array((begin - words.first[own])[order].astype(np.int32)))
            kept = order[first]
            own = pa.array(own[kept] + part.start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(label[kept])), pa.array(signed(label_check[kept])), pa.array(ids).take(own), marks.take(own), places, pa.array(n[kept].astype(np.int32)), pa.array(probe[kept]), edges.take(pa.array(kept))],
                names=["label", "check", "doc_id", "_t", "places", "n", "probe", "edges"],
            )

    return rows


def _with_first(rows: DataFrame, keys: list[str], *first: str | Column) -> DataFrame:
    """Adds ``own``, the least of ``first`` among the rows that share the keys. Rows are dealt out before, so that no column is shuffled twice."""
    return rows.repartition(*keys).withColumn("own", F.min(F.struct(*first)).over(Window.partitionBy(*keys)))


def _found_ranges(docs: DataFrame, k: int, m: int) -> DataFrame:
    """What ``repeated_spans`` returns, as arrays: doc_id, _t, ranges."""
    seen = arrow_map(docs, _path_rows(k, m), "bin long, label long, check long, doc_id long, _t string, at int, n int")
    # A group's first row and its others meet in a window, so rows are shuffled once for each way they are grouped.
    first, bin_ = ("doc_id", "_t", "at", "check"), Window.partitionBy("bin")
    bins = _with_first(seen, ["bin"], *first).withColumns({"hi": F.max("doc_id").over(bin_), "branching": F.min("label").over(bin_) != F.max("label").over(bin_)})
    shared = bins.filter("own.doc_id < hi and (branching or doc_id > own.doc_id and check = own.check)")
    shared = cut(shared.select("label", "check", "doc_id", "_t", "at", "n", "branching", F.struct("own.doc_id", "own.at").alias("own")))
    span = lambda at: F.struct(at.alias("start"), (at + F.col("n") + F.lit(k - 1)).alias("end"), F.col("own.doc_id").alias("source"), F.col("own.at").alias("source_start"))
    found = ["doc_id", "_t", F.array(span(F.col("at"))).alias("ranges")]
    at_places = ["doc_id", "_t", F.transform("places", span).alias("ranges")]
    straight = shared.filter("not branching").select(*found)
    # Equal labels and equal edges lie in one bin, so they are found without it.
    forks = shared.filter("branching").select("label", "check", "doc_id", "_t", "at", "n", F.col("own.doc_id").alias("lo"))
    owned = cut(_with_first(forks, ["label", "check"], *first).drop("label", "check"))
    compacted = owned.filter("doc_id > own.doc_id").select(*found)
    opened = owned.filter("doc_id = own.doc_id").groupBy("doc_id", "_t").agg(F.collect_set(F.expr("2 * at + int(doc_id > lo)")).alias("opened"))
    edges = "edges array<struct<edge: long, check: long, after: int, n: int>>"
    runs = arrow_map(docs.join(opened, ["doc_id", "_t"]), _run_rows(k, m), f"label long, check long, doc_id long, _t string, places array<int>, n int, probe boolean, {edges}")
    earliest = ("doc_id", F.col("places")[0].alias("at"))
    # This holds for every run. It makes both steps that read runs ask for all columns, so that Spark makes and shuffles the runs once for both.
    runs = _with_first(runs, ["label", "check"], *earliest).filter("n > 0 and size(edges) > 0")
    alike = runs.filter("probe and doc_id > own.doc_id").select(*at_places)
    # A run that starts in an earlier document has nothing to say about its edges that this one's does not.
    edges = runs.filter("doc_id = own.doc_id").select("doc_id", "_t", "probe", "places", F.explode("edges").alias("e"))
    edges = edges.select("e.edge", "e.check", "doc_id", "_t", F.transform("places", lambda p: p + F.col("e.after")).alias("places"), "e.n", "probe")
    # A bin's first document has nothing to look for in it.
    single = _with_first(edges, ["edge", "check"], *earliest).filter("probe and doc_id > own.doc_id").select(*at_places)
    return straight.unionByName(compacted).unionByName(alike).unionByName(single)


def repeated_spans(docs: DataFrame, k: int = K, m: int = MINIMISER) -> DataFrame:
    """Word ranges [start, end) of documents whose k-word windows all start in documents of smaller doc_id.

    ``docs`` has doc_id, text and _t, which tells rows of one doc_id and different texts apart. Ranges may overlap. ``source`` and ``source_start`` say where a
    range's words are first; a repeated word's range has the place of one window there.
    """
    return _found_ranges(docs, k, m).select("doc_id", "_t", F.inline("ranges"))


_ADDED = ("kept_text", "n_words", "n_removed", "spans", "sources")


def _cut_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    own_columns = [c for c in batch.schema.names if c != "ranges"]
    texts, n_words, n_removed, spans = [], [], [], []
    ranges = batch.column("ranges")
    lengths = pc.fill_null(ranges.value_lengths(), 0).to_numpy()
    ends = np.cumsum(lengths)
    flat_ranges = ranges.flatten()
    left, right = flat_ranges.field("start").to_numpy(), flat_ranges.field("end").to_numpy()
    for part, words in documents_in(batch):
        for i in range(part.start, part.stop):
            a, b = words.first[i - part.start], words.first[i - part.start + 1]
            n = b - a
            if not lengths[i]:
                gone = np.zeros(n, bool)
            else:
                own = slice(ends[i] - lengths[i], ends[i])
                change = np.bincount(left[own], minlength=n + 1)[: n + 1] - np.bincount(right[own], minlength=n + 1)[: n + 1]
                gone = np.cumsum(change)[:n] > 0
            keep = a + np.flatnonzero(~gone)
            raw = words.raw
            if len(keep):
                # Bytes of the kept words, each followed by a space; the last space is dropped.
                s, e = words.starts[keep], words.ends[keep]
                size = e - s + 1
                at = np.repeat(s - np.cumsum(size) + size, size) + np.arange(size.sum())
                out = np.append(raw, np.uint8(0x20))[np.minimum(at, len(raw))]
                out[np.cumsum(size) - 1] = 0x20
                texts.append(out[:-1].tobytes().decode("utf-8"))
            else:
                texts.append("")
            n_words.append(int(n))
            n_removed.append(int(gone.sum()))
            step = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own_columns), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), ranges], names=[*own_columns, *_ADDED])


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), k: int = K, m: int = MINIMISER) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, ``keep``): these, kept_text, n_words, n_removed, the removed word spans, and the
    sources of what was found (start, end, source document and first word there; null where nothing was)."""
    # All columns go into both steps that read texts, and only rows with a doc_id, so that Spark deals the texts out once for both.
    keep = tuple(c for c in keep if c not in (*_ADDED, "doc_id", "text", "_t", "_again", "ranges"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    repeated = cut(base.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("_again")))
    n = repeated.count()
    if n:
        base = base.join(F.broadcast(repeated) if n <= MOST_REPEATED else repeated, "doc_id", "left")
        mark = F.when(F.col("_again"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))
        base = base.withColumn("_t", F.coalesce(mark, F.lit(""))).drop("_again")
    else:
        base = base.withColumn("_t", F.lit(""))
    named = base.filter("doc_id is not null")
    ranges = _found_ranges(named, k, m).groupBy("doc_id", "_t").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    sources = "array<struct<start: int, end: int, source: long, source_start: int>>"
    both = named.join(ranges, ["doc_id", "_t"], "left").select(*base.columns, F.col("ranges").cast(sources).alias("ranges"))
    rest = base.filter("doc_id is null").withColumn("ranges", F.lit(None).cast(sources))
    # The first side of a union keeps its aliases, and with one the texts' shuffle would not be that of the other step.
    out = arrow_map(rest.unionByName(both), _cut_rows, f"{kinds}, kept_text string, n_words long, n_removed long, spans array<struct<start: int, end: int>>, sources {sources}")
    return out.drop("_t")
