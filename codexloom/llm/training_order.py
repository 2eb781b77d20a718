"""Training-order materialisation: every sequence gets a global slot from a keyed permutation.

All documents in order of (doc_id, hash of the text) form one stream of token ids, each document ended by the end token;
sequences are its consecutive cuts of ``length`` ids, so only the last one is padded. Sequence numbers follow from
running totals of token counts, so they depend on the rows alone, not on files, partitions or the cluster. A balanced
Feistel network over the smallest even power of two that holds the count permutes the numbers; values beyond the count are
walked round the cycle until they fall inside, which keeps the map a bijection of 0..n-1. No sort by random keys and no
table of the permutation is needed, and any slot can be found (or inverted) from the key alone. Slots are cut into shards
of ``per_shard`` rows; a task gets a contiguous range of shards, in slot order, and writes each as a file of fixed-stride
records, so that a reader finds slot s at byte (s - first) * stride and can resume anywhere.

Ids move once: they are written compressed to a table bucketed by the part that made them, the running totals come back to
that table as one array a part, and the exchange by slot takes the pieces of documents to their shards.

Defined results: null text is empty, so its only id is the end token; repeated rows are in the stream each; null doc_id
comes first; the last sequence is padded with zeros and ``n_tokens`` gives its length; an empty table gives no sequence;
other columns are ignored. A record takes two bytes an id, or four where the vocabulary has more than 65,536.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batched, cut, ensure_checkpoint_dir, mix, running_total
from .tokens import encoded, encoder

LENGTH, END, ROUNDS, PER_SHARD = 1024, 1, 6, 1 << 14


def _round(half: np.ndarray, key: int, i: int, bits: int) -> np.ndarray:
    salt = np.uint64((key * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) & (2**64 - 1))
    return mix(half ^ salt) >> np.uint64(64 - bits)


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The slot of each index below n (or the index of each slot)."""
    bits = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << bits) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(bits), x & mask
        for i in range(ROUNDS):
            if inverse:
                left, right = right ^ _round(left, key, ROUNDS - 1 - i, bits), left
            else:
                left, right = right, left ^ _round(right, key, i, bits)
        return (left << np.uint64(bits)) | right

    out = once(np.asarray(index).astype(np.uint64))
    while (out_of := out >= np.uint64(n)).any():  # walk the cycle
        out[out_of] = once(out[out_of])
    return out.astype(np.int64)


def _encoded_rows(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, small = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=6)
        for batch in batches:
            if batch.num_rows:
                whole = [np.append(ids, np.array(end, ids.dtype)) for _, ids in encoded(batch, tokenizer)]
                size = pa.array([len(x) for x in whole], pa.int64())
                places = [pa.array(np.full(len(whole), part, np.int32)), pa.array(np.arange(row, row + len(whole), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_t"), size, *places, pa.array([small.compress(x) for x in whole], pa.binary())], names=["doc_id", "_t", "n", "_part", "_row", "ids"])
                row += len(whole)

    return run


def shared_table(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder as a table of its own, and read it again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def shard_folder(spark: SparkSession) -> str:
    """A new folder's name for shards, below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4().hex}"
    return place.removeprefix("file:") if place.startswith("file:/") and "://" not in place else place


def in_training_order(docs: DataFrame, tokenizer: str, key: int, length: int = LENGTH, per_shard: int = PER_SHARD, end: int = END) -> DataFrame:
    """The pieces of documents at their places: slot, shard, at (the first id's place in the sequence), doc_id, start (of
    its document's ids), n_tokens, ids (compressed). Partitions hold contiguous shards, ordered by slot and place."""
    spark = docs.sparkSession
    batched(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_t"))
    made = source.mapInArrow(_encoded_rows(tokenizer, end), "doc_id long, _t long, n long, _part int, _row int, ids binary")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"codexloom_ids_{uuid.uuid4().hex}"
    # As many buckets as parts: each part is one file, and the join below leaves it where it is.
    made.write.bucketBy(max(least, source.rdd.getNumPartitions()), "_part").format("parquet").saveAsTable(name)
    rows = spark.table(name)
    first = running_total(rows.select("doc_id", "_t", "n", "_part", "_row"), ["doc_id", "_t", "_part", "_row"], "n", "_first")
    firsts = cut(first.groupBy("_part").agg(F.array_sort(F.collect_list(F.struct("_row", "_first"))).alias("_f")).select("_part", F.col("_f._first").alias("_firsts")))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, width = -(-total // length), encoder(tokenizer).kind.itemsize
    shards = -(-n // per_shard)
    tasks = max(1, min(shards, max(least, -(-n * width * length // (128 << 20)))))

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        large, small = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=6)
        begin, size = batch.column("_at").to_numpy(), batch.column("n").to_numpy()
        count = (begin + size - 1) // length - begin // length + 1
        row = np.repeat(np.arange(len(begin)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        number = begin[row] // length + nth
        start = np.where(nth == 0, 0, number * length - begin[row])
        stop = np.minimum((number + 1) * length - begin[row], size[row])
        ids, held, out = batch.column("ids"), -1, []
        for r, a, b, c in zip(row, start * width, stop * width, count[row], strict=True):
            if c == 1:
                out.append(ids[int(r)].as_py())
                continue
            if r != held:
                held, whole = r, large.decompress(ids[int(r)].as_py())
            out.append(small.compress(whole[a:b]))
        slot = permute(number, n, key)
        shard = slot // per_shard
        columns = [pa.array(slot), pa.array(shard.astype(np.int32)), pa.array((begin[row] + start - number * length).astype(np.int32)), batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array((stop - start).astype(np.int32)), pa.array(out, pa.binary()), pa.array((shard * tasks // max(shards, 1)).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "at", "doc_id", "start", "n_tokens", "ids", "_task"])

    indexed = rows.join(firsts, "_part").select("doc_id", "n", "ids", F.expr("get(_firsts, _row)").alias("_at"))
    placed = arrow_map(indexed, pieces, "slot long, shard int, at int, doc_id long, start long, n_tokens int, ids binary, _task int")
    return placed.repartitionById(tasks, F.col("_task")).sortWithinPartitions("slot", "at").drop("_task")


def write_shards(ordered: DataFrame, folder: str, tokenizer: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write each shard as ``shard-<number>.bin`` below ``folder`` (a path or URI that pyarrow opens on all machines).

    A shard is written under a name of its attempt and then renamed, so a task that runs again replaces its own
    files. Returns a row per record: slot, shard, byte_offset, n_tokens, crc32 (of the record), and its documents in
    order, as doc_ids and starts.
    """
    stride = length * encoder(tokenizer).kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        name, out, large = "", None, zstandard.ZstdDecompressor()
        shard, slot, parts, size, ids, starts = -1, -1, [], 0, [], []
        done: list[tuple] = []

        def record() -> None:
            whole = b"".join(parts).ljust(stride, b"\0")
            if len(whole) != stride:
                raise ValueError(f"slot {slot} has {len(whole)} bytes")
            out.write(whole)
            done.append((slot, shard, slot % per_shard * stride, size, zlib.crc32(whole), ids, starts))

        def close() -> None:
            out.close()
            store.move(name, f"{root}/shard-{shard:08d}.bin")

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate(kinds)], names=["slot", "shard", "byte_offset", "n_tokens", "crc32", "doc_ids", "starts"])
            done.clear()
            return made

        for batch in batches:
            for s, h, d, a, n, x in zip(*(batch.column(c).to_pylist() for c in ("slot", "shard", "doc_id", "start", "n_tokens", "ids")), strict=True):
                if s != slot:
                    if slot >= 0:
                        record()
                    if h != shard:
                        if slot >= 0:
                            close()
                        name = f"{root}/.{uuid.uuid4().hex}"
                        out = store.open_output_stream(name)
                    shard, slot, parts, size, ids, starts = h, s, [], 0, [], []
                parts.append(large.decompress(x))
                size += n
                ids.append(d)
                starts.append(a)
            if len(done) >= 4096:
                yield rows()
        if slot >= 0:
            record()
            close()
        yield rows()

    batched(ordered.sparkSession)
    return ordered.mapInArrow(run, "slot long, shard int, byte_offset long, n_tokens int, crc32 long, doc_ids array<long>, starts array<long>")


def manifest(records: DataFrame) -> DataFrame:
    """A row per shard: shard, first_slot, records, n_tokens."""
    return records.groupBy("shard").agg(F.min("slot").alias("first_slot"), F.count("*").alias("records"), F.sum("n_tokens").alias("n_tokens"))


def read_from(folder: str, slot: int, per_shard: int = PER_SHARD, length: int = LENGTH, width: int = 2) -> Iterator[np.ndarray]:
    """Records from a slot on, in order: how a trainer resumes."""
    stride = width * length
    while os.path.exists(name := f"{folder}/shard-{slot // per_shard:08d}.bin"):
        with open(name, "rb") as f:
            f.seek(slot % per_shard * stride)
            while record := f.read(stride):
                yield np.frombuffer(record, f"<u{width}")
                slot += 1
        if slot % per_shard:
            return
