"""Interval and neighbour joins.

Overlap joins are equi-joins on (group, bucket): each interval is listed under the buckets it touches, and a pair is kept only in
the bucket where the later of the two starts, so it appears once. No pair outside a shared bucket is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import CHUNK, carried


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], l_start: str, l_end: str, r_start: str, r_end: str, width: int) -> DataFrame:
    """Pairs with l_start <= r_end and r_start <= l_end (closed ends)."""
    buckets = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {width}"), F.expr(f"{b} div {width}")))
    a, b = left.withColumn("_bucket", buckets(l_start, l_end)), right.withColumn("_bucket", buckets(r_start, r_end))
    pairs = a.join(b, [*on, "_bucket"]).filter((F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end)))
    return pairs.filter(F.col("_bucket") == F.greatest(F.expr(f"{l_start} div {width}"), F.expr(f"{r_start} div {width}"))).drop("_bucket")


def next_at_or_after(left: DataFrame, right: DataFrame, on: list[str], l_at: str, r_at: str, value: str) -> DataFrame:
    """As-of join forward: the nearest right row at or after each left row, by one sort of the union of both."""
    tagged = left.withColumn("_at", F.col(l_at)).withColumn("_right", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(0))
    other = right.select(*on, F.col(r_at).alias("_at"), F.col(value).alias("_right"), F.lit(1).alias("_side"))
    both = tagged.unionByName(other, allowMissingColumns=True)
    # From the far end, so that the frame only grows and each row costs one step.
    w = Window.partitionBy(*on).orderBy(F.desc("_at"), F.desc("_side"), F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    best = F.last(F.when(F.col("_side") == 1, F.struct("_at", "_right")), ignorenulls=True).over(w)
    return both.withColumn("_found", best).filter("_side = 0").select(*left.columns, F.col("_found._right").alias(value), F.col("_found._at").alias(r_at))


def merged_spans(rows: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Union of closed intervals per group; touching ones (next start = end + 1 or less) join."""
    w = Window.partitionBy(*group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0))
    step = step.withColumn("_island", F.sum("_new").over(w))
    return step.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_island")


def runs(rows: DataFrame, group: list[str], order: str, flag: str, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive flagged rows: first, last, n."""
    w = Window.partitionBy(*group).orderBy(order)
    step = rows.withColumn("_r", F.row_number().over(w)).filter(flag)
    step = step.withColumn("_g", F.col("_r") - F.row_number().over(w))
    return step.groupBy(*group, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("_g")


def pieces(left: DataFrame, right: DataFrame, key: list[str], l_id: str, r_id: str, size: int = CHUNK) -> DataFrame:
    """The left intervals cut at the bounds of the right ones: key, ``l_id``, start, end, ``r_id`` (null between right intervals).

    Both sides have ``start`` and ``end`` (half open, integers from 0); intervals of one side do not overlap each other, though they may
    touch, and lie in, around and across those of the other side. One sweep over all bounds: an interval is two rows however long it is, and
    no pair is formed. Bounds within ``size`` are a chunk. Empty intervals, null bounds and null ids give nothing.
    """
    ends = lambda rows, side, i: rows.filter(f"start < end and `{i}` is not null").select(*key, F.explode(F.array(F.struct(F.col("start").cast("long").alias("at"), F.col(i).alias(f"_{side}"), F.lit(1).alias(f"_s{side}")), F.struct(F.col("end").cast("long").alias("at"), F.lit(None).cast(rows.schema[i].dataType).alias(f"_{side}"), F.lit(0).alias(f"_s{side}")))).alias("_b")).select(*key, "_b.*")
    bounds = ends(left, "l", l_id).unionByName(ends(right, "r", r_id), allowMissingColumns=True)
    # Where one interval ends and the next begins, the beginning counts.
    state = lambda side: F.max_by(F.when(F.col(f"_s{side}").isNotNull(), F.struct(F.col(f"_{side}").alias("v"))), F.col(f"_s{side}"))
    bounds = bounds.groupBy(*key, "at").agg(state("l").alias("_l"), state("r").alias("_r"))
    bounds = carried(bounds, key, ["at"], F.expr(f"at div {size}"), lag={"_from": F.col("at")}, last={"_in": F.col("_l"), "_with": F.col("_r")})
    return bounds.filter("_in.v is not null").select(*key, F.col("_in.v").alias(l_id), F.col("_from").alias("start"), F.col("at").alias("end"), F.col("_with.v").alias(r_id))


def first_overlap(left: DataFrame, right: DataFrame, key: list[str], r_id: str, size: int = CHUNK) -> DataFrame:
    """``left`` (start, end, half open) with the id of the first right interval that overlaps it, null where none does.

    Right intervals do not overlap each other and are not empty; the first one that ends behind a row's start is the only candidate, and
    one sort from the far end brings it to the row.
    """
    other = right.filter("start < end").select(*key, F.col("end").cast("long").alias("_at"), F.lit(0).alias("_side"), F.struct(F.col("start").alias("s"), F.col(r_id).alias("v")).alias("_right"))
    own = left.withColumns({"_at": F.col("start").cast("long") + 1, "_side": F.lit(1), "_row": F.monotonically_increasing_id()})
    both = own.unionByName(other, allowMissingColumns=True).withColumn("_back", -F.col("_at"))
    found = carried(both, key, ["_back", "_side", "_row"], F.expr(f"-(_at div {size})"), last={"_found": F.col("_right")})
    return found.filter("_side = 1").select(*left.columns, F.when(F.col("_found.s") < F.col("end"), F.col("_found.v")).alias(r_id))


def paired(marks: DataFrame, bodies: DataFrame, key: list[str], order: str, name: str, size: int = CHUNK) -> DataFrame:
    """Marks (key, ``order``, ``name``) with the ``order`` of their body, as ``body``, null where none is left.

    A mark takes the first body of its name, which several marks may share; then the marks without one and the bodies that no mark
    has named pair off in their order. ``order`` is an integer from 0 on, unique on either side of a key.
    """
    first = bodies.filter(F.col(name).isNotNull()).groupBy(*key, name).agg(F.min(order).alias("_named"))
    named = marks.join(first, [*key, name], "left")
    taken = named.filter("_named is not null").select(*key, F.col("_named").alias(order)).distinct()
    free = bodies.join(taken, [*key, order], "left_anti").select(*key, order)
    count = lambda rows: carried(rows.withColumn("_one", F.lit(1)), key, [order], F.expr(f"{order} div {size}"), total={"_rank": F.col("_one")}).drop("_one")
    loose = count(named.filter("_named is null").select(*key, order))
    pairs = loose.join(count(free).select(*key, "_rank", F.col(order).alias("_loose")), [*key, "_rank"]).drop("_rank")
    return named.join(pairs, [*key, order], "left").select(*marks.columns, F.coalesce("_named", "_loose").alias("body"))
