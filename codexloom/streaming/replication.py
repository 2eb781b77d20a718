"""Replicated state as a stream: log lines of all devices in, the winning value of each key out.

The fold is the same aggregation as in batch, in update mode; state is one row a key, kept without a bound in time since an
old operation may come late and simply loses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.replication import changes, merged, valid_ops
from ..schema import OP_LINE


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of one JSON-lines file per device as a stream; malformed lines go."""
    return valid_ops(spark.readStream.schema(OP_LINE).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(folder))


def folded(ops: DataFrame) -> DataFrame:
    best = F.max(F.struct("millis", "counter", "device", "value"))
    return ops.groupBy("key").agg(best.alias("b")).select("key", "b.value", "b.millis", "b.counter", "b.device")


def run_available(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Fold what is there into a table below ``folder``, then stop.

    Each batch's changed keys are merged with the version before it and written beside that as the next version; the greatest
    complete version is the state (``state_of``). A batch that runs again writes the same version anew.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, folder) if v < n]
        have = spark.read.schema(batch.schema).parquet(f"{folder}/{max(before)}") if before else batch.limit(0)
        merged(have.unionByName(batch)).write.mode("overwrite").parquet(f"{folder}/{n}")

    query = stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions below a folder, by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return [int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]


def state_of(spark: SparkSession, folder: str) -> DataFrame:
    """The folded state; no rows before the first version."""
    versions = _versions(spark, folder)
    if not versions:
        return spark.createDataFrame([], "key string, value string, millis long, counter long, device string")
    return spark.read.parquet(f"{folder}/{max(versions)}")


def pull_cycle(prepare: Callable[[], None], fetch: Callable[[], None], sync: Callable[[], None], push: Callable[[], None]) -> list[str]:
    """One round of exchange; a step that fails is reported by name and does not keep the later ones from running."""
    failed = []
    for name, step in (("prepare", prepare), ("fetch", fetch), ("sync", sync), ("push", push)):
        try:
            step()
        except Exception as e:  # noqa: BLE001  the cycle never raises
            failed.append(f"{name}: {type(e).__name__}: {e}")
    return failed


def append_ops(lines: DataFrame, folder: str, device: str) -> None:
    """Add log lines (k, v, t, d) to a device's own folder of the log."""
    lines.coalesce(1).write.mode("append").json(f"{folder}/{device}")


def pull(state: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: the batch's strictly newer winners go to ``write`` together with the merged state."""

    def step(batch: DataFrame, _: int) -> None:
        have = state()
        write(changes(have, batch), merged(have.unionByName(batch)))

    return step
