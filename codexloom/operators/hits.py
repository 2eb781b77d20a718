"""The nearest small mark whose halo holds a position, by grids of halved and doubled cells.

A mark's halo is a box. Its cell size is the power of two that its longer side asks for, so the box lies in four cells at most, however
large marks are; a position is looked up once in each of the sizes that occur. No other pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A halo reaches this many times the mark's size beyond it, and this many points at least.
PAD, LEAST = 1.5, 22.0


def nearest_marks(positions: DataFrame, marks: DataFrame, key: list[str], pad: float = PAD, least: float = LEAST) -> DataFrame:
    """``positions`` (key, at, x, y) with ``mark``: of the marks (key, mark, left, top, width, height) whose halo holds the position the one whose
    middle is nearest by the sum of both distances; ties go to the smaller mark, null where none is. ``at`` tells positions of a key apart.
    """
    reach = lambda side: F.greatest(F.lit(least), pad * F.col(side))
    boxes = marks.select(*key, "mark", (F.col("left") - reach("width")).alias("_x0"), (F.col("left") + F.col("width") + reach("width")).alias("_x1"), (F.col("top") - reach("height")).alias("_y0"), (F.col("top") + F.col("height") + reach("height")).alias("_y1"), (F.col("left") + F.col("width") / 2).alias("_cx"), (F.col("top") + F.col("height") / 2).alias("_cy"))
    boxes = boxes.withColumn("_cell", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))))))
    cell = lambda c: F.floor(F.col(c) / F.col("_cell"))
    levels = [r[0] for r in boxes.select("_cell").distinct().collect() if r[0] is not None]  # powers of two: no more than a double has exponents
    spread = boxes.withColumn("_gx", F.explode(F.sequence(cell("_x0"), cell("_x1")))).withColumn("_gy", F.explode(F.sequence(cell("_y0"), cell("_y1"))))
    probes = positions.select(*key, "at", "x", "y", F.explode(F.array(*map(F.lit, levels)).cast("array<double>")).alias("_cell")).withColumns({"_gx": cell("x"), "_gy": cell("y")})
    met = probes.join(spread, [*key, "_cell", "_gx", "_gy"]).filter("x between _x0 and _x1 and y between _y0 and _y1")
    best = met.groupBy(*key, "at").agg(F.min(F.struct((F.abs(F.col("x") - F.col("_cx")) + F.abs(F.col("y") - F.col("_cy"))).alias("d"), "mark")).alias("_b"))
    return positions.join(best.select(*key, "at", F.col("_b.mark").alias("mark")), [*key, "at"], "left")
