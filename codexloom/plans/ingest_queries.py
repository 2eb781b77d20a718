"""Queries over sources: HTML blocks of the pages table, round trips, and the streamed fold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import blocks, osis, plans
from ..streaming import replication as stream
from .library_queries import _FOLD, _OPS, ops_of
from .registry import query, table


@query()
def html_blocks(spark, d):
    return blocks.pages(table(spark, d, "pages"))


@query()
def html_sections(spark, d):
    return blocks.sections(blocks.pages(table(spark, d, "pages")), "page_id")


# Runs of white space are one space in what comes back; the texts' own are collapsed on both sides.
@query(r"SELECT CAST(conv_id % 66 AS INT) AS book, CAST(conv_id + 1 AS INT) AS chapter, CAST(turn + 1 AS INT) AS verse, trim(regexp_replace(text, '[\s]+', ' ', 'g')) AS text FROM conversations WHERE trim(text) <> ''")
def osis_roundtrip(spark, d):
    rows = table(spark, d, "conversations").filter("trim(text) <> ''").select(F.concat(F.lit("M"), (F.col("conv_id") % 5).cast("string")).alias("code"), F.lit("en").alias("language"), F.lit("Test").alias("title"), (F.col("conv_id") % 66).cast("int").alias("book"), (F.col("conv_id") + 1).cast("int").alias("chapter"), (F.col("turn") + 1).cast("int").alias("verse"), "text", (F.col("turn") == 0).alias("paragraph"))

    @F.pandas_udf("array<struct<book: int, chapter: int, verse: int, text: string>>")
    def back(xml):
        import pandas as pd

        return pd.Series([[{k: r[k] for k in ("book", "chapter", "verse", "text")} for r in osis.parse(x.encode()) if r["kind"] == "verse"] for x in xml])

    return osis.documents(rows).select(F.explode(back("xml")).alias("v")).select("v.*")


@query("SELECT doc_id, doc_id % 6 < 2 AS valid FROM documents")
def plan_validation(spark, d):
    """A plan for every document: whole, without a source, empty, without days, with an empty day, or no JSON."""
    day = "array(struct(concat('1Mo ', doc_id % 50 + 1) as label, concat('Gen.', doc_id % 50 + 1) as osis))"
    whole = f"to_json(struct(concat('Plan ', doc_id) as name, if(doc_id % 6 = 0, source, null) as source, array({day}, {day}) as days))"
    text = f"case doc_id % 6 when 2 then '{{}}' when 3 then concat('{{\"name\":\"', doc_id, '\",\"days\":[]}}') when 4 then concat('{{\"name\":\"', doc_id, '\",\"days\":[[]]}}') when 5 then left(text, 20) else {whole} end"
    rows = table(spark, d, "documents").select("doc_id", F.expr(text).alias("json"))
    return plans.parsed(rows).select("doc_id", "valid")


@query(f"WITH {_OPS} SELECT key, value, s[1] AS millis, s[2] AS counter, s[3] AS device FROM ({_FOLD.format('ops')})")
def lww_stream(spark, d):
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    lines = ops_of(spark, d).select(F.col("key").alias("k"), F.col("value").alias("v"), F.array("millis", "counter").alias("t"), F.col("device").alias("d"))
    lines.write.json(f"{place}/log")
    stream.run_available(stream.folded(stream.read_log(spark, f"{place}/log")), f"{place}/table", f"{place}/state")
    return stream.state_of(spark, f"{place}/table")
