"""Vectorised text primitives and Spark helpers that several operators share.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; a UTF-8 multi-byte
character never contains such a byte, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from ..session import importable, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step takes at once; a single longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch that goes to a Python worker, so that a worker holds a few MB of texts at a time.
BATCH_ROWS = 1024
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 1024

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ONE, _TWO, _LENGTH = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
#: Keeps the first n bytes of a little-endian load of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; a local session that has none gets a local one, a cluster is asked to name one."""
    shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``raw`` on, as integers; zeros follow the end."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits of each range of bytes, chained over loads of eight bytes; one to one for ranges of up to seven bytes.

    Each salt gives hashes of their own: words that share one under a salt do so under another by chance only.
    """
    eights, size = _eights(raw), ends - starts
    head = np.minimum(size, 8)
    # Of eight or more bytes only seven go in first, so that the length has a byte of its own.
    out = mix((eights[starts] & _FIRST[np.minimum(head, 7)]) | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56)) ^ np.uint64(salt))
    at = np.flatnonzero(size > 7)
    long = at[size[at] > LONG_WORD]
    at, done = at[size[at] <= LONG_WORD], 7
    while len(at):
        here = eights[starts[at] + done] & _FIRST[np.minimum(size[at] - done, 8)]
        out[at] = mix((out[at] + _LENGTH) ^ (here + np.uint64(salt)) * _ONE)
        done += 8
        at = at[size[at] > done]
    at = np.flatnonzero(size >= 255)
    out[at] = mix(out[at] + size[at].astype(np.uint64) * _LENGTH)
    for i in long:
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return out


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of a from each a_at on equal those of b from b_at on."""
    x, y = _eights(a), _eights(b)
    equal, at, done = np.ones(len(size), bool), np.flatnonzero(size > 0), 0
    while len(at):
        keep = _FIRST[np.minimum(size[at] - done, 8)]
        differ = (x[a_at[at] + done] & keep) != (y[b_at[at] + done] & keep)
        equal[at[differ]] = False
        done += 8
        at = at[~differ & (size[at] > done)]
    return equal


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order. Every step is mixed, so that no algebra of a sequence carries over to its hash."""
    return mix(x * _ONE + mix(y ^ _LENGTH) * _TWO)


def _doubled(x: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all runs of 1, 2, 4.. values, up to ``longest``."""
    span = 1
    yield span, x
    while span * 2 <= longest:
        x, span = _pair(x[:-span], x[span:]), span * 2
        yield span, x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and each row's offsets; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(end, n)
        row = end


class Words:
    """Words of consecutive documents: byte ranges, 64-bit hashes, and each document's first word.

    Hashes find equal words and runs; where a result must not rest on them, callers compare the bytes.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None):
        """cuts: where words are cut besides, between byte i and i + 1."""
        self.raw, base = raw, offsets - offsets[0]
        solid = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        if cuts is not None:
            edge[1:-1] = cuts
        edge[base] = True
        before = np.concatenate(([False], solid))
        after = np.concatenate((solid, [False]))
        first = after & (~before | edge)
        last = before & (~after | edge)
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last)
        self.first = np.searchsorted(self.starts, base)  # of each document, and of the end
        self.hashes = _word_hashes(raw, self.starts, self.ends)

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words, also those across documents. Two overlapping runs of a power of two make one of k."""
        n = len(self.hashes) - k + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        for span, x in _doubled(self.hashes, k):
            pass
        return _pair(x[:n], x[k - span : k - span + n])

    def ranges(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of words [start, end), none of them empty."""
        size, out = ends - starts, np.empty(len(starts), np.uint64)
        words = _word_hashes(self.raw, self.starts, self.ends, salt) if salt else self.hashes
        for span, x in _doubled(words, int(size.max(initial=1))):
            at = np.flatnonzero((size >= span) & (size < 2 * span))
            out[at] = _pair(x[starts[at]], x[ends[at] - span] + size[at].astype(np.uint64) * _LENGTH)
        return out

    def owner(self) -> np.ndarray:
        """The document's index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def documents_in(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[slice, Words]]:
    raw, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    for a, b in steps(offsets):
        yield slice(a, b), Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def spread_rank(df: DataFrame, group: list[str], order: list[str], out: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """A dense number from 0 per group in the given order, without taking a group into one task.

    Rows are range-partitioned by (group, order) into buckets by a hash-free rule: the sample-based
    range partitioner decides the bucket, its number is written with the row, and each bucket's offset is
    the sum of the smaller buckets' counts. ``df`` should be cheap to read again (a checkpoint).
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    n = max(1, -(-df.count() // rows_per_bucket))
    placed = cut(df.repartitionByRange(n, *group, *order).withColumn("_bucket", F.spark_partition_id()))
    inner = Window.partitionBy("_bucket", *group).orderBy(*order)
    counts = placed.groupBy("_bucket", *group).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_bucket") if group else Window.partitionBy(F.lit(0)).orderBy("_bucket")
    offsets = counts.select("_bucket", *group, (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    ranked = placed.withColumn("_r", F.row_number().over(inner))
    on = ["_bucket", *group]
    return ranked.join(offsets, on).withColumn(out, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_bucket", "_before", "_r")


def running_total(df: DataFrame, order: list[str], value: str, out: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """The sum of ``value`` over all rows before this one in the given order, without one task for all rows.

    As in ``spread_rank``, a range partition is summed by itself and learns the sum of the partitions before it.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    n = max(1, -(-df.count() // rows_per_bucket))
    placed = cut(df.repartitionByRange(n, *order).withColumn("_bucket", F.spark_partition_id()))
    before = lambda column, window: F.sum(column).over(window) - F.col(column)
    sums = placed.groupBy("_bucket").agg(F.sum(value).alias("_sum")).select("_bucket", before("_sum", Window.orderBy("_bucket")).alias("_before"))
    own = placed.withColumn("_own", before(value, Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(sums, "_bucket").withColumn(out, F.col("_before") + F.col("_own")).drop("_bucket", "_before", "_own")


def following(keys: DataFrame, key: str, out: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """Adds to different keys the next one in ascending order; the last one's is the first.

    A range partition orders its own keys; only the partitions' first keys, one per ``rows_per_bucket``, are ordered together.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    n = max(1, -(-keys.count() // rows_per_bucket))
    placed = cut(keys.select(key).repartitionByRange(n, key).withColumn("_bucket", F.spark_partition_id()))
    order = Window.orderBy("_bucket")
    heads = placed.groupBy("_bucket").agg(F.min(key).alias("_head"))
    after = heads.select("_bucket", F.coalesce(F.lead("_head").over(order), F.first("_head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    own = placed.withColumn("_next", F.lead(key).over(Window.partitionBy("_bucket").orderBy(key)))
    return own.join(after, "_bucket").select(key, F.coalesce("_next", "_after").alias(out))


def block_of(ids: DataFrame, key: str, rows: int, quantiles: int = 2048) -> Column:
    """A column of ``key`` that numbers blocks of ascending integer ids, about ``rows`` in each.

    The ids are split at approximate quantiles and every piece into blocks of even width, so an outlier widens the
    blocks of its own piece only: whatever the ids are, a block has no more of them than a piece has.
    """
    from pyspark.sql import functions as F

    n, low, high = ids.agg(F.count(key), F.min(key), F.max(key)).first()
    if not n:
        return F.lit(0).cast("long")
    quantiles = min(quantiles, -(-n // rows))
    marks = ids.agg(F.percentile_approx(key, [i / quantiles for i in range(quantiles)], 20 * quantiles)).first()[0]
    bounds = sorted({low, *marks})
    per = max(1, -(-n // (quantiles * rows)))  # blocks of a piece
    each = [min(1 << 62, max(1, -(-(b - a) // per))) for a, b in zip(bounds, [*bounds[1:], high + 1], strict=True)]
    step = 1 << (len(bounds) - 1).bit_length() - 1 if len(bounds) > 1 else 0
    longs = lambda values: "array(" + ", ".join(f"{v}L" if v > -(1 << 63) else "cast('-9223372036854775808' as bigint)" for v in values) + ")"
    steps = ", ".join(str(step >> i) for i in range(step.bit_length())) or "0"
    at = f"aggregate(array({steps}), 0, (i, s) -> if(i + s < {len(bounds)} and get({longs(bounds)}, i + s) <= {key}, i + s, i))"
    # Differences of ids can leave 64 bits, so they are taken as decimals.
    inside = f"least(cast({per - 1} as bigint), cast((cast({key} as decimal(38,0)) - get({longs(bounds)}, _at)) div get({longs(each)}, _at) as bigint))"
    return F.expr(f"get(transform(array({at}), _at -> cast(_at as bigint) * {per} + {inside}), 0)")


def batched(spark: SparkSession) -> None:
    """Ready a session for Python workers: the package can be imported, and batches are small unless the session has set a size."""
    importable(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    batched(df.sparkSession)
    return df.mapInArrow(run, schema)
