"""Source divergence audit over term-block dense matrices.

Each language's terms are dealt into blocks by hash and its sources into blocks as well. A task holds the counts of two blocks of
sources for one block of terms as dense int64 tiles, turns them into smoothed shares p, and takes f = (p - q)^2 // q of all pairs
of sources by broadcasting, which it sums over the block's terms. The partial pair matrices of all blocks are added up, and so
are each source's most typical terms against its language: a block keeps ``TOP`` a source, the blocks' lists are merged.

All arithmetic is in integers: shares are divided in steps of a thousand, exact up to 9e15 term occurrences, and a sum of f
stays below (1e9 + V)^2 for V terms.

Defined results: null text, lang and source count as ''; rows with a repeated or null doc_id are documents of their own (doc_id
is never read); a language without kept terms has pairs of value 0, one with a single source has none, and an empty table gives an
empty result; texts are read whole, a longer one than a step's bytes as a step of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, cut, flat, steps

#: Documents of a language that a kept term must be in, units of a share, and terms listed a source.
LEAST_DOCUMENTS, UNIT, TOP = 3, 1_000_000_000, 200
#: Terms and sources of a tile.
TERMS, SOURCES = 1024, 256
#: Text bytes whose counts a task adds up before it gives them on.
STEP = 8 << 20
#: Languages up to which their table is broadcast.
FEW = 100_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of consecutive texts, and the text of each."""
    letter = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets - offsets[0]] = True
    before, after = np.concatenate(([False], letter)), np.concatenate((letter, [False]))
    starts, ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    packed = np.ascontiguousarray(_LOWER[raw[letter]])
    places = np.concatenate(([0], np.cumsum(ends - starts)))
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(packed))
    return terms, np.searchsorted(offsets - offsets[0], starts, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count, docs of some megabytes of text at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.get_total_buffer_size()
        if size >= STEP:
            yield from _counts(held)
            held, size = [], 0
    if held:
        yield from _counts(held)


def _counts(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    if not table.num_rows:
        return
    groups = pa.StructArray.from_arrays([table.column(c).combine_chunks().cast(pa.string()) for c in ("lang", "source")], names=["lang", "source"])
    lang, source = (groups.field(i).dictionary_encode() for i in range(2))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    text = table.column("text").combine_chunks()
    raw, offsets = flat(text)
    for a, b in steps(offsets, STEP):
        words, owner = terms_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1])
        if not len(words):
            continue
        coded = words.dictionary_encode()
        own, of = np.unique(group[a:b], return_inverse=True)
        # One sort by (group, term, text): runs are a text's occurrences of a term, runs of runs a group's.
        key = (of[owner] * len(coded.dictionary) + coded.indices.to_numpy()) * (b - a) + owner
        key, n = np.unique(key, return_counts=True)
        pair = key // (b - a)
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        counts, docs = np.add.reduceat(n, first), np.diff(np.append(first, len(pair)))
        g, term = own[pair[first] // len(coded.dictionary)], pair[first] % len(coded.dictionary)
        langs, sources = lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary)))
        for s in range(0, len(first), 1 << 16):
            at = slice(s, s + (1 << 16))
            yield pa.RecordBatch.from_arrays([langs[at], sources[at], coded.dictionary.take(pa.array(term[at])).cast(pa.string()), pa.array(counts[at]), pa.array(docs[at])], names=["lang", "source", "term", "count", "docs"])


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / whole) for count < whole < 9e15, without leaving 64 bits."""
    count, whole = np.broadcast_arrays(count + 1, whole)
    out, rest = count // whole, count % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _tile(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Values of one block of terms: pairs of two blocks of sources, and the first block's typical terms if both are one."""
    groups, entries = groups.combine_chunks(), entries.combine_chunks()
    side = groups.column("sb").to_numpy()
    left, right = groups.column("gi")[0].as_py(), groups.column("gj")[0].as_py()
    lang, names = groups.column("lang")[0].as_py(), groups.column("source").combine_chunks()
    whole = groups.column("n").to_numpy() + groups.column("v").to_numpy()
    lang_whole = groups.column("lang_n")[0].as_py() + groups.column("v")[0].as_py()
    terms = pc.unique(entries.column("term"))
    terms = terms.take(pc.sort_indices(terms))  # by UTF-8 bytes
    counts = np.zeros((len(names), len(terms)), np.int64)
    row, col = (pc.index_in(entries.column(c), value_set=x).to_numpy() for c, x in (("source", names), ("term", terms)))
    counts[row, col] = entries.column("count").to_numpy()
    total = np.zeros(len(terms), np.int64)
    total[col] = entries.column("total").to_numpy()
    p = shares(counts, whole[:, None])
    unseen, n_unseen = shares(np.zeros(len(names), np.int64), whole), groups.column("n_terms")[0].as_py() - len(terms)
    a, b = np.flatnonzero(side == left), np.flatnonzero(side == right)
    parts: list[tuple[np.ndarray, str, pa.Array, np.ndarray]] = []
    for i, j in [(a, b)] if left == right else [(a, b), (b, a)]:
        value = np.empty((len(i), len(j)), np.int64)
        for at, k in enumerate(j):
            value[:, at] = divergence(p[i], p[k]).sum(1) + n_unseen * divergence(unseen[i], unseen[k])
        x, y = np.nonzero(i[:, None] != j)
        parts.append((i[x], "pair", names.take(pa.array(j[y])), value[x, y]))
    if left == right and len(terms):
        q = shares(total, np.int64(lang_whole))
        f = divergence(p, q)
        for k in a:
            at = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            at = at[np.argsort(-f[k, at], kind="stable")[:TOP]]  # of equal values the smaller term comes first
            parts.append((np.full(len(at), k), "term", terms.take(pa.array(at)), f[k, at]))
    sources = pa.concat_arrays([names.take(pa.array(x[0])) for x in parts])
    kinds, items = pa.array([x[1] for x in parts for _ in range(len(x[0]))], pa.string()), pa.concat_arrays([x[2] for x in parts])
    return pa.table({"lang": pa.array([lang] * len(sources), pa.string()), "source": sources, "part": kinds, "item": items, "value": np.concatenate([x[3] for x in parts])})


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, total (in the language), leads (once a term of a language) of terms in enough documents."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")  # no more rows than the language has sources
    known = counted.select("lang", "source", "term", "count", F.sum("docs").over(whole).alias("docs"), F.sum("count").over(whole).alias("total"), (F.col("source") == F.min("source").over(whole)).alias("leads"))
    return cut(known.filter(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"))


def audit(docs: DataFrame, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """Per language and source of ``docs`` (text, lang, source): other sources and typical terms, ranked: lang, source, part, item, value, rank."""
    batched(docs.sparkSession)
    kept = kept_terms(docs)
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = cut(groups.join(kept.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    langs = kept.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.sum(F.col("leads").cast("long")).alias("v"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("_g")).join(langs, "lang", "left")
    least_one = lambda column, size: F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(column), F.lit(0)) / size)).cast("int")
    langs = cut(langs.select("lang", F.coalesce("lang_n", F.lit(0)).alias("lang_n"), F.coalesce("v", F.lit(0)).alias("v"), least_one("v", terms).alias("_tb"), least_one("_g", sources).alias("_sb")))
    langs = F.broadcast(langs) if langs.count() <= FEW else langs
    block = lambda c, n: F.expr(f"cast(pmod(xxhash64({c}), {n}) as int)")
    # Each row goes to every pair of source blocks that its own is in.
    meet = F.expr("explode(sequence(0, _sb - 1))")
    pairs = lambda rows: rows.withColumn("_o", meet).withColumn("gi", F.least("sb", "_o")).withColumn("gj", F.greatest("sb", "_o")).drop("_o", "_sb", "_tb")
    entries = kept.join(langs.select("lang", "_tb", "_sb"), "lang").withColumn("tb", block("term", "_tb")).withColumn("sb", block("source", "_sb"))
    n_terms = entries.filter("leads").groupBy("lang", "tb").agg(F.count("*").alias("n_terms"))
    tiles = groups.join(langs, "lang").withColumn("sb", block("source", "_sb")).withColumn("tb", F.expr("explode(sequence(0, _tb - 1))"))
    tiles = pairs(tiles.join(n_terms, ["lang", "tb"], "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0))))
    key = ("lang", "tb", "gi", "gj")
    entries = pairs(entries).select(*key, "source", "term", "count", "total")
    tiles = tiles.select(*key, "source", "sb", "n", "v", "lang_n", "n_terms")
    found = cut(entries.groupBy(*key).cogroup(tiles.groupBy(*key)).applyInArrow(_tile, "lang string, source string, part string, item string, value long"))
    pair = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair, term = (x.select("lang", "source", "part", "item", "value", rank.alias("rank")) for x in (pair, found.filter("part = 'term'")))
    return pair.unionByName(term.filter(F.col("rank") <= TOP))
