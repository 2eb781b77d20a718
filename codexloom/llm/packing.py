"""Best-fit decreasing packing of token pieces, planned on the histogram of piece lengths.

Pieces of equal length are interchangeable, so best-fit decreasing over all pieces equals best-fit decreasing
over (length, count). The plan keeps open sequences in classes by remaining capacity; a segment tree over the
capacities finds the tightest class that holds a piece in logarithmic time. A class's sequences are placed as
one run, and the plan's input has at most ``capacity`` rows at any corpus size. Pieces then learn their
sequence by an equi-join on (length, block of ranks).

Defined results: null text is empty; an empty document is one piece of its end token; texts above the capacity,
and only those, are cut; ties between sequences of equal remaining capacity go to the oldest run, between pieces
to the smaller (doc_id, piece); rows that share a doc_id are packed each; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, spread_rank
from .tokens import encoded

CAPACITY, END = 4096, 1


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity that says which have open sequences."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, value: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = value
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, least: int) -> int:
        """The smallest open capacity of at least ``least``, or -1."""
        i = least + self.leaves
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return -1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset): piece of rank first+i goes to sequence first+i."""
    tree, classes, runs, made = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first, there = capacity, made, left
            else:
                first, there = classes[room].popleft()
            # The rest of the tightest sequence is tighter still: each is filled before the next is touched.
            per = room // length
            full, rest = divmod(left, per)
            fill = [(first, min(full, there), per)] if min(full, there) else []
            if full < there and rest:
                fill.append((first + full, 1, rest))
            for begin, n, deep in fill:
                for j in range(deep):
                    runs.append((length, rank, n, begin, capacity - room + j * length))
                    rank, left = rank + n, left - n
                if room > deep * length:
                    classes[room - deep * length].append((begin, n))
                    tree.set(room - deep * length, True)
            used = sum(n for _, n, _ in fill)
            if room == capacity:
                made += used
            else:
                if used < there:
                    classes[room].appendleft((first + used, there - used))
                tree.set(room, bool(classes[room]))
    return runs


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, piece, start, length, crc = [], [], [], [], []
        for i, ids in encoded(batch, tokenizer):
            whole = np.append(ids, end).astype("<u4")
            for j in range(0, len(whole), capacity):
                own = whole[j : j + capacity]
                at.append(i)
                piece.append(j // capacity)
                start.append(j)
                length.append(len(own))
                crc.append(zlib.crc32(own.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int = CAPACITY, block: int = 1 << 16) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of 1 to capacity."""
    spark = pieces.sparkSession
    pieces = cut(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = plan(counts, capacity)
    # A run that crosses a block of ranks is listed under each block, so that the join below has an equality.
    blocks = [(length, b, rank, n, first, offset) for length, rank, n, first, offset in runs for b in range(rank // block, (rank + n - 1) // block + 1)]
    table = spark.createDataFrame(blocks or [], "length long, _block long, _from long, _n long, _first long, offset long")
    ranked = spread_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank").withColumn("_block", F.expr(f"_rank div {block}"))
    joined = ranked.join(table, ["length", "_block"]).filter("_rank >= _from and _rank < _from + _n")
    return joined.select(*pieces.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return place(pieces_of(docs, tokenizer, capacity), capacity)
