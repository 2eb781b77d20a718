"""Reading plans from JSON: {name, source?, days: [[{label, osis}]]}."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = "name string, source string, days array<array<struct<label: string, osis: string>>>"


def parsed(rows: DataFrame, column: str = "json") -> DataFrame:
    """Adds plan and valid: a name and days, no empty day, every passage with a label and a passage id."""
    out = rows.withColumn("plan", F.from_json(column, SHAPE))
    days = F.col("plan.days")
    good = F.forall(days, lambda d: (F.size(d) > 0) & F.forall(d, lambda p: p["label"].isNotNull() & (p["label"] != "") & p["osis"].rlike(r"^[1-3]?[A-Z][A-Za-z]*\.\d+(\.\d+)?(-[1-3]?[A-Z][A-Za-z]*\.\d+\.\d+)?$")))
    return out.withColumn("valid", F.coalesce((F.trim("plan.name") != "") & (F.size(days) > 0) & good, F.lit(False)))


def upserted(plans: DataFrame, new: DataFrame) -> DataFrame:
    """By name; a new plan replaces the old one."""
    return plans.join(new.select("name"), "name", "left_anti").unionByName(new.select(*plans.columns))
