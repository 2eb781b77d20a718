"""Writing the library: replacing, merging, renaming and deleting modules, and table storage.

A table is a folder of one partition per module code. A module is replaced by overwriting only its partitions, so readers of other
modules are not touched; the upsert semantics of each kind of import are applied to the incoming rows before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .library import UnknownModule, concatenated, last_wins


def replace_module(rows: DataFrame, path: str) -> None:
    """Put in the rows' modules (column ``code``), instead of what was there of them."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("code").parquet(path)


def delete_module(spark: SparkSession, path: str, code: str) -> DataFrame:
    """The table without a module; an unknown one is an error. The caller writes what is left beside the table and swaps."""
    rows = spark.read.parquet(path)
    if rows.filter(F.col("code") == code).isEmpty():
        raise UnknownModule(code)
    return rows.filter(F.col("code") != code)


def delete_module_whole(spark: SparkSession, paths: dict[str, str], titles: DataFrame, code: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables (name to folder) without a module, and the titles without its override. ``module`` must know the code."""
    left = {"module": delete_module(spark, paths["module"], code)}
    left |= {name: spark.read.parquet(path).filter(F.col("code") != code) for name, path in paths.items() if name != "module"}
    return left, titles.filter(F.col("code") != code)


def commentary_rows(entries: DataFrame) -> DataFrame:
    """Entries of a packaged commentary: the last one of a verse stays."""
    return last_wins(entries, ["code", "book", "chapter", "verse_start"], "pos").drop("pos")


def dictionary_rows(entries: DataFrame) -> DataFrame:
    """Entries of a dictionary or devotional: the last one of a sort number stays."""
    return last_wins(entries, ["code", "sort"], "pos").drop("pos")


def book_rows(sections: DataFrame) -> DataFrame:
    """Sections of a book: the last one of an ordinal stays."""
    return last_wins(sections, ["code", "ordinal"], "pos").drop("pos")


def without_plan(plans: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """The plans without one, and whether it was there."""
    return plans.filter(F.col("name") != name), not plans.filter(F.col("name") == name).isEmpty()


def exported_labels(kv: DataFrame, prefix: str = "label/") -> DataFrame:
    """The values below a prefix that are not empty, in key order, for a text file of JSON lines."""
    return kv.filter(F.startswith("key", F.lit(prefix)) & (F.col("value") != "")).orderBy("key").select("value")


def plain_text(verses: DataFrame) -> DataFrame:
    """A line ``book chapter:verse text`` per verse, in canon order, for a text file."""
    return verses.orderBy("book", "chapter", "verse").select(F.concat_ws(" ", F.col("osis"), F.concat_ws(":", F.col("chapter").cast("string"), F.col("verse").cast("string")), "text").alias("value"))


def renamed(titles: DataFrame, code: str, title: str) -> DataFrame:
    """Overriding titles with one set, or taken away by an empty title."""
    rest = titles.filter(F.col("code") != code)
    title = title.strip()
    return rest.unionByName(titles.sparkSession.createDataFrame([(code, title)], "code string, title string")) if title else rest


def bible_rows(verses: DataFrame, joined: bool) -> DataFrame:
    """Rows (code, book, chapter, verse, pos, text, paragraph) with duplicates joined in order, or the last one kept."""
    key = ["code", "book", "chapter", "verse"]
    return concatenated(verses, key, "pos", "text", ("paragraph",)) if joined else last_wins(verses, key, "pos").drop("pos")


def merged_entries(entries: DataFrame) -> DataFrame:
    """Commentary entries (code, book, chapter, verse_start, verse_end, pos, heading, text) that share a start become one:
    texts joined by a blank line in reading order, the greatest end, the first heading; ``shift`` lists each part's byte offset."""
    key = ["code", "book", "chapter", "verse_start"]
    parts = F.array_sort(F.collect_list(F.struct("pos", "text", "heading")))
    out = entries.groupBy(*key).agg(F.max("verse_end").alias("verse_end"), parts.alias("_p"))
    sizes = "transform(slice(_p, 1, i), p -> octet_length(p.text) + 2)"
    return out.select(
        *key, "verse_end", F.expr("get(filter(_p, p -> p.heading is not null), 0).heading").alias("heading"), F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n").alias("text"),
        F.expr(f"transform(_p, (p, i) -> struct(p.pos as pos, aggregate({sizes}, 0, (a, x) -> a + x) as bytes))").alias("shift"),
    )


def shifted_refs(refs: DataFrame, merged: DataFrame) -> DataFrame:
    """References (code, book, chapter, verse_start, pos, ref_start, ref_end, osis) moved with their part, numbered anew from 1."""
    key = ["code", "book", "chapter", "verse_start"]
    at = merged.select(*key, F.explode("shift").alias("s")).select(*key, F.col("s.pos").alias("pos"), F.col("s.bytes").alias("_by"))
    moved = refs.join(at, [*key, "pos"]).withColumns({"ref_start": F.col("ref_start") + F.col("_by"), "ref_end": F.col("ref_end") + F.col("_by")})
    return moved.withColumn("seq", F.row_number().over(Window.partitionBy(*key).orderBy("ref_start"))).drop("_by", "pos")


def comments_with_refs(comments: DataFrame, refs: DataFrame) -> DataFrame:
    """Each comment with its references in order; none is an empty list."""
    key = ["code", "book", "chapter", "verse_start"]
    own = refs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "ref_start", "ref_end", "osis"))).alias("refs"))
    empty = F.array().cast("array<struct<seq: int, ref_start: int, ref_end: int, osis: string>>")
    return comments.join(own, key, "left").withColumn("refs", F.coalesce("refs", empty))


def set_keys(kv: DataFrame, new: DataFrame) -> DataFrame:
    """Key/value upsert."""
    return kv.join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "value"))


def decoded(json: Column, schema: str) -> Column:
    """A JSON column; null where it is missing or no JSON of that shape."""
    return F.from_json(json, schema)
