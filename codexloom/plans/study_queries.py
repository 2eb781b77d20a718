"""Reading-desk and import-rule queries bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import replication, study
from .library_queries import _OPS, ops_of
from .registry import query, table


@query("SELECT l_orderkey, count(l_partkey) <> count(DISTINCT l_partkey) AS ambiguous FROM lineitem GROUP BY l_orderkey")
def label_ambiguity(spark, d):
    return study.ambiguous_labels(table(spark, d, "lineitem").withColumnRenamed("l_partkey", "label"), ["l_orderkey"])


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25 OFFSET 50")
def block_listing(spark, d):
    return study.listing(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 50, 25)


@query("SELECT p_partkey, p_partkey AS sort, CAST(NULL AS VARCHAR) AS search FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL, p_name FROM part WHERE p_partkey % 2 = 1")
def entry_anchors(spark, d):
    parts = table(spark, d, "part").withColumn("anchor", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" G000"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("q:"), F.col("p_name"))))
    return parts.select("p_partkey", study.entry_anchor(F.col("anchor")).alias("sort"), study.anchor_after(F.col("anchor"), "q").alias("search"))


@query(f"WITH {_OPS} SELECT s.millis AS millis, s.counter AS counter FROM (SELECT max({{'millis': millis, 'counter': counter}}) AS s FROM ops)")
def latest_stamp(spark, d):
    return replication.latest(ops_of(spark, d))


@query(r"SELECT conv_id, turn, regexp_extract(trim(text), '^[^ ]*[a-z]') AS head, upper(replace(text, 'ß', 'ss')) AS caps FROM conversations WHERE role = 'user'")
def small_caps_heads(spark, d):
    rows = table(spark, d, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", F.regexp_extract(F.trim("text"), "^[^ ]*[a-z]", 0).alias("head"), rules.small_caps(F.col("text"), F.lit(True)).alias("caps"))


@query(r"SELECT conv_id, turn, CAST(regexp_extract(line, '^([0-9]{1,3}) ', 1) AS INTEGER) AS number, regexp_replace(line, '^[0-9]{1,2}[.] ', '') AS rest FROM (SELECT conv_id, turn, turn || CASE WHEN conv_id % 2 = 0 THEN ' ' ELSE '. ' END || 'x' AS line FROM conversations) WHERE regexp_matches(line, '^[0-9]{1,3} ') UNION ALL SELECT conv_id, turn, NULL, 'x' FROM conversations WHERE conv_id % 2 = 1 AND turn < 100")
def leading_numbers(spark, d):
    rows = table(spark, d, "conversations").withColumn("line", F.concat(F.col("turn").cast("string"), F.when(F.col("conv_id") % 2 == 0, " ").otherwise(". "), F.lit("x")))
    return rows.select("conv_id", "turn", rules.leading_number(F.col("line")).alias("number"), rules.without_list_mark(F.col("line")).alias("rest"))
