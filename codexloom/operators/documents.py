"""Layout inference from positioned text, and interpretation of documents, as dataflows keyed by document.

Lines come from ``lines``, blocks from ``blocks``, numbered verses of typed parts from ``verses``; here are the counts, modes and ranks
over them. ``y`` grows downward.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import importable

def profile(rows: DataFrame) -> DataFrame:
    """Per document: body size (weighted mode of characters; a larger size with 40 % of the text takes over), left edge (mode),
    right edge (value at 9/10 of the ordered list), all from counts of distinct values."""
    sizes = rows.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"))
    whole = Window.partitionBy("doc_id")
    ranked = sizes.withColumn("_all", F.sum("n").over(whole)).withColumn("_top", F.max_by("size", F.struct("n", "size")).over(whole))
    body = ranked.groupBy("doc_id").agg(F.coalesce(F.max(F.when((F.col("size") > F.col("_top")) & (F.col("n") >= 0.4 * F.col("_all")), F.col("size"))), F.first("_top")).alias("body_size"))
    left = rows.groupBy("doc_id", "x").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max_by("x", F.struct("n", -F.col("x"))).alias("left_edge"))
    counts = rows.groupBy("doc_id", "right").agg(F.count("*").alias("n"))
    upto = counts.withColumn("_upto", F.sum("n").over(whole.orderBy("right"))).withColumn("_all", F.sum("n").over(whole))
    right = upto.groupBy("doc_id").agg(F.min(F.when(F.col("_upto") > F.expr("_all * 9 div 10"), F.col("right"))).alias("right_edge"))
    return body.join(left, "doc_id").join(right, "doc_id")


def without_furniture(rows: DataFrame, band: float = 0.09, least: int = 3, page_height: float = 800.0) -> DataFrame:
    """Without lines of the top and bottom bands that are numbers or whose text, digits aside, recurs on ``least`` pages."""
    in_band = (F.col("y") < band * page_height) | (F.col("y") > (1 - band) * page_height)
    key = F.trim(F.regexp_replace(F.lower("text"), "[0-9]+", "#"))
    keyed = rows.withColumn("_band", F.when(F.col("y") < page_height / 2, 0).otherwise(1)).withColumn("_key", key).withColumn("_in", in_band)
    often = keyed.filter("_in").groupBy("doc_id", "_band", "_key").agg(F.count_distinct("page").alias("_n")).filter(F.col("_n") >= least)
    marked = keyed.join(often, ["doc_id", "_band", "_key"], "left")
    return marked.filter(~(F.col("_in") & (F.col("_n").isNotNull() | F.col("text").rlike(r"^[\s0-9ivxlc.–-]+$")))).drop("_band", "_key", "_in", "_n")


def gutter(fragments: DataFrame, bin_width: float = 4.0) -> DataFrame:
    """Per page the widest empty run between covered bins of x: gutter_from, gutter_to."""
    ends = fragments.select("doc_id", "page", F.floor(F.col("x") / bin_width).alias("_a"), F.floor((F.col("x") + F.col("width")) / bin_width).alias("_b")).filter("_a is not null and _b is not null")
    # A fragment covers all bins between its ends, so of those that begin in one bin the farthest end tells all, and no bin becomes a row.
    covered = ends.groupBy("doc_id", "page", F.least("_a", "_b").alias("_next")).agg(F.max(F.greatest("_a", "_b")).alias("_to"))
    before = Window.partitionBy("doc_id", "page").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
    gaps = covered.withColumn("b", F.max("_to").over(before)).filter("_next > b + 1")
    best = gaps.groupBy("doc_id", "page").agg(F.max_by(F.struct("b", "_next"), F.struct(F.col("_next") - F.col("b"), -F.col("b"))).alias("g"))
    return best.select("doc_id", "page", ((F.col("g.b") + 1) * bin_width).alias("gutter_from"), (F.col("g._next") * bin_width).alias("gutter_to"))


def heading_level(rows: DataFrame) -> DataFrame:
    """Levels by rank of sizes above the body's, at most 6; consecutive headings of one size on one page are one."""
    sized = rows.join(profile(rows).select("doc_id", "body_size"), "doc_id").filter(F.col("size") > 1.1 * F.col("body_size"))
    level = F.least(F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))), F.lit(6))
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    step = sized.withColumn("level", level).withColumn("_new", F.when((F.lag("size").over(w) == F.col("size")) & (F.lag("line").over(w) == F.col("line") - 1), 0).otherwise(1))
    grouped = step.withColumn("_g", F.sum("_new").over(w)).groupBy("doc_id", "page", "_g").agg(F.min("line").alias("line"), F.first("level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("text"))
    return grouped.drop("_g")


def detected(features: DataFrame) -> DataFrame:
    """kind from counts (verse_numbers, chapters, paragraphs, has_subject, scripture, refs, sampled, refs_sampled)."""
    dense = "(refs_sampled * 100 >= 15 * sampled and refs_sampled >= 3)"
    return features.withColumn("kind", F.expr(f"case when verse_numbers >= 50 and chapters >= 2 and 2 * verse_numbers >= paragraphs then 'bible' when has_subject and (scripture >= 10 or {dense} or (scripture >= 2 and refs >= 3)) then 'commentary' else 'book' end"))


_NUMBERED = re.compile(r"(?<!\S)(\d{1,3})\s+(?=\S)")
VERSES = "doc_id long, chapter int, verse int, text string, paragraph boolean"


def verses(blocks: DataFrame) -> DataFrame:
    """Numbered verses from paragraphs (doc_id, pos, kind, text): a heading that ends in a number opens its chapter, a number
    that follows the last verse opens the next one, a 1 after verses opens the next chapter, other text goes on."""
    importable(blocks.sparkSession)

    def document(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        chapter, verse, doc = 0, 0, int(rows["doc_id"].iloc[0])
        for kind, text in rows.sort_values("pos", kind="stable")[["kind", "text"]].itertuples(index=False):
            if kind == "heading":
                if m := re.search(r"(\d+)\s*$", text):
                    chapter, verse = int(m[1]), 0
                continue
            at, opens = 0, True
            for m in _NUMBERED.finditer(text):
                n = int(m[1])
                rolls = n == 1 and verse > 0
                if n != verse + 1 and not rolls:
                    continue
                if (held := text[at : m.start()].strip()) and out:
                    out[-1][3] = (out[-1][3] + " " + held).strip()
                chapter, verse = (chapter + 1 if rolls or not chapter else chapter), n
                out.append([doc, chapter, verse, "", opens and not text[: m.start()].strip()])
                at, opens = m.end(), False
            if (rest := text[at:].strip()) and out:
                out[-1][3] = (out[-1][3] + " " + rest).strip()
        return pd.DataFrame(out, columns=["doc_id", "chapter", "verse", "text", "paragraph"])

    return blocks.groupBy("doc_id").applyInPandas(document, VERSES)


def settled_paragraphs(rows: DataFrame) -> DataFrame:
    """Flags carry nothing where 9 in 10 of at least 20 inner verses open a paragraph: then all are cleared."""
    w = Window.partitionBy("doc_id", "chapter").orderBy("verse")
    inner = rows.withColumn("_inner", F.lag("verse").over(w).isNotNull())
    ratio = inner.groupBy("doc_id").agg(F.count_if("_inner").alias("_n"), F.count_if(F.col("_inner") & F.col("paragraph")).alias("_f"))
    return rows.join(ratio, "doc_id").withColumn("paragraph", F.col("paragraph") & ~((F.col("_n") >= 20) & (F.col("_f") * 10 >= F.col("_n") * 9))).drop("_n", "_f")


def commentary(blocks: DataFrame, book: str, names: object) -> DataFrame:
    """Sections from headings that name a passage: chapter, verse_start, verse_end, heading and the text below."""
    importable(blocks.sparkSession)
    from ..functions.references import scan

    def document(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for kind, text in rows.sort_values("pos", kind="stable")[["kind", "text"]].itertuples(index=False):
            found: Iterator = scan(text, names, None, None) if kind == "heading" else iter(())
            at = next((f for f in found if f.verse is not None), None)
            if at:
                out.append([int(rows["doc_id"].iloc[0]), at.book, at.chapter, at.verse, at.last or at.verse, text, ""])
            elif out:
                out[-1][6] = "\n\n".join(filter(None, (out[-1][6], text)))
        return pd.DataFrame(out, columns=["doc_id", "book", "chapter", "verse_start", "verse_end", "heading", "text"])

    return blocks.groupBy("doc_id").applyInPandas(document, "doc_id long, book int, chapter int, verse_start int, verse_end int, heading string, text string")
