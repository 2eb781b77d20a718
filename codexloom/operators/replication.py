"""Replicated key/value state: last writer wins by stamp (millis, counter, device), in batch.

The fold is an aggregation with map-side combine (max_by on the stamp), so a hot key costs one row per task. Equal stamps are
settled by the greater value, which makes the result independent of reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stamp() -> Column:
    return F.struct("millis", "counter", "device")


def valid_ops(lines: DataFrame) -> DataFrame:
    """Parsed log lines (k, v, t, d) without the malformed ones, as key, value, millis, counter, device."""
    good = lines.filter("k is not null and v is not null and d is not null and size(t) = 2 and t[0] is not null and t[1] is not null")
    return good.select(F.col("k").alias("key"), F.col("v").alias("value"), F.col("t")[0].alias("millis"), F.col("t")[1].alias("counter"), F.col("d").alias("device"))


def merged(ops: DataFrame) -> DataFrame:
    """The winning op of each key."""
    best = F.max(F.struct("millis", "counter", "device", "value"))
    return ops.groupBy("key").agg(best.alias("b")).select("key", "b.value", "b.millis", "b.counter", "b.device")


def changes(state: DataFrame, ops: DataFrame) -> DataFrame:
    """Winning ops that are strictly newer than the state's stamp of their key."""
    known = state.select("key", stamp().alias("_have"))
    return merged(ops).join(known, "key", "left").filter(F.col("_have").isNull() | (stamp() > F.col("_have"))).drop("_have")


def applied(state: DataFrame, ops: DataFrame) -> DataFrame:
    return merged(state.select("key", "value", "millis", "counter", "device").unionByName(ops))


def compacted(ops: DataFrame, device: str) -> DataFrame:
    """A device's own log with the latest op of each key, in stamp order."""
    return merged(ops.filter(F.col("device") == device)).orderBy("millis", "counter", "device", "key")


def healing(state: DataFrame, log: DataFrame, device: str) -> DataFrame:
    """State rows that this device stamped and its own log lacks or has older."""
    own = merged(log.filter(F.col("device") == device)).select("key", stamp().alias("_logged"))
    mine = state.filter(F.col("device") == device)
    return mine.join(own, "key", "left").filter(F.col("_logged").isNull() | (stamp() > F.col("_logged"))).drop("_logged")


def live(state: DataFrame) -> DataFrame:
    """Without tombstones (empty values)."""
    return state.filter("value <> ''")


def clock_ticks(events: DataFrame, device: str, now: str) -> DataFrame:
    """The hybrid clock's stamp of each event of a device, in the order of seq: a later time resets the counter, else it counts on."""
    w = Window.partitionBy(device).orderBy("seq")
    high = events.withColumn("millis", F.max(now).over(w))
    return high.withColumn("counter", (F.row_number().over(Window.partitionBy(device, "millis").orderBy("seq")) - 1).cast("long"))


def latest(ops: DataFrame) -> DataFrame:
    """The greatest stamp seen, as one row; null stamps where there is none."""
    return ops.agg(F.max(F.struct("millis", "counter")).alias("s")).select("s.millis", "s.counter")


def received(clock: Column, seen: Column) -> Column:
    """A clock (millis, counter) after it has seen a stamp."""
    return F.greatest(clock, seen)


def ticked(clock: Column, now: Column) -> Column:
    """A clock's next stamp: the time if that is later, else one count on."""
    kind = "struct<millis: bigint, counter: bigint>"
    on = F.struct(clock["millis"].alias("millis"), (clock["counter"] + 1).alias("counter")).cast(kind)
    return F.when(clock.isNull() | (now > clock["millis"]), F.struct(now.alias("millis"), F.lit(0).alias("counter")).cast(kind)).otherwise(on)


def written(state: DataFrame, puts: DataFrame, device: str, clock: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Values (seq, key, value, now) set on a device: the state after them, and the log lines to append.

    Stamps count on from the clock, which is the greatest stamp of the state unless it is given.
    """
    millis, counter = clock if clock is not None else latest(state).first() or (None, None)
    base = F.lit(-1 if millis is None else millis)
    w = Window.partitionBy("_device").orderBy("seq")
    high = puts.withColumn("_device", F.lit(device)).withColumn("millis", F.greatest(F.max("now").over(w), base).cast("long"))
    same = F.row_number().over(Window.partitionBy("_device", "millis").orderBy("seq")) - 1
    ops = high.withColumn("counter", (same + F.when(F.col("millis") == base, F.lit((counter or 0) + 1)).otherwise(0)).cast("long"))
    ops = ops.select("key", "value", "millis", "counter", F.lit(device).alias("device"))
    return applied(state, ops), ops.select(F.col("key").alias("k"), F.col("value").alias("v"), F.array("millis", "counter").alias("t"), F.col("device").alias("d"))


def needs_compaction(log: DataFrame, device: str, most: int = 200) -> bool:
    """Whether a device's own log has more lines than ``most``."""
    return log.filter(F.col("device") == device).limit(most + 1).count() > most
