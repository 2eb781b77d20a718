"""Footnotes at the foot of pages, split from the lines of the body.

A note block is a run of small lines in the lower half of a page. It begins at a line with a label, or, where the page before ended
in notes, at the page's first small low line without one: the rest of a note that the page turn broke. Whether a page has notes may thus
hang on the page before, and that one's on the one before it: a step of two states for each page, which ``ordered.states`` composes, so a
document's pages may lie in any number of tasks. A page's own lines, which paper bounds, meet in one.

Lines: doc_id, pos, page, top (downward), size, bold, text. A null doc_id or page belongs to no page; other nulls count as 0, false and ''.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import note_label
from ..functions.text import collapse_space
from ..session import cut
from .ordered import CHUNK, FOLD, carried, states


def split(lines: DataFrame, profile: DataFrame, page_height: float = 800.0, size: int = CHUNK) -> DataFrame:
    """doc_id, pos, page, text, note: the number of the line's note from 1 on, null in the body; label: where a note begins.

    Small is less than the body's size by 12 %, and by 0.6 at least. ``size`` lines are a chunk; the result does not depend on it."""
    rows = lines.filter("page is not null").select("doc_id", "pos", F.col("page").cast("long").alias("page"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("top", "size")), F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.select("doc_id", "pos", "page", "text")
    rows = rows.withColumn("label", note_label(F.col("text"))).drop("text")  # texts stay behind: only labels go on
    rows = rows.join(profile.select("doc_id", "body_size"), "doc_id")
    small = F.col("size") < F.col("body_size") - F.greatest(0.12 * F.col("body_size"), F.lit(0.6))
    low = small & (F.col("top") > 0.5 * page_height) & ~F.col("bold")
    rows = cut(rows.select("doc_id", "pos", "page", "label", small.alias("small"), low.alias("low")))
    found = rows.filter("low").groupBy("doc_id", "page").agg(F.count("label").alias("_labels"), F.min_by(F.struct(F.col("label").isNull().alias("bare"), "pos"), "pos").alias("_first"))
    pages = rows.select("doc_id", "page").distinct().join(found, ["doc_id", "page"], "left")
    pages = carried(pages, ["doc_id"], ["page"], F.expr(f"page div {size}"), lag={"_was": F.col("page")})
    # A page with labels has notes; one whose first small low line has none has notes if the page right before it does.
    goes_on = F.coalesce(F.col("_first.bare") & (F.col("_was") == F.col("page") - 1), F.lit(False))
    pages = pages.select("doc_id", "page", F.when(goes_on, F.col("_first.pos")).alias("_bare"), F.when(F.coalesce("_labels", F.lit(0)) > 0, "11").when(goes_on, "01").otherwise("00").alias("_move"))
    pages = states(pages, ["doc_id"], "page", F.col("_move"), "_noted", 0, max(2, min(size, FOLD)))
    begun = pages.filter("_noted = 1 and _bare is not null").select("doc_id", "page", "_bare")
    rows = rows.join(begun, ["doc_id", "page"], "left")
    starts = F.col("low") & (F.col("label").isNotNull() | F.coalesce(F.col("pos") == F.col("_bare"), F.lit(False)))
    upto = Window.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.last(F.when(~F.col("small"), False).when(starts, True), ignorenulls=True).over(upto), F.lit(False))
    rows = rows.withColumn("_in", inside).withColumn("label", F.when(F.col("_in"), F.col("label")))
    opens = F.col("label").isNotNull().cast("long")
    rows = carried(rows.select("doc_id", "pos", "label", "_in"), ["doc_id"], ["pos"], F.expr(f"pos div {size}"), total={"_n": opens})
    rows = rows.select("doc_id", "pos", F.when(F.col("_in"), F.col("_n") + opens).alias("note"), "label")
    return texts.join(rows, ["doc_id", "pos"]).select("doc_id", "pos", "page", "text", "note", "label")


def notes(lines: DataFrame) -> DataFrame:
    """doc_id, note, page (where it begins), label and text of what ``split`` has found. The label is cut off, broken words are joined."""
    rows = lines.filter("note is not null")
    own = F.when(F.col("label").isNotNull(), F.expr(r"regexp_replace(substring(text, length(label) + 1), '^[.  ]+', '')")).otherwise(F.col("text"))
    rows = rows.withColumn("_t", F.rtrim(own))
    following = F.lead("_t").over(Window.partitionBy("doc_id", "note").orderBy("pos"))
    soft, hard = F.col("_t").rlike("­$"), F.col("_t").rlike(".-$") & following.rlike(r"^\p{Ll}")
    piece = F.when(following.isNull(), F.col("_t")).when(soft, F.regexp_replace("_t", "­$", "")).when(hard, F.regexp_replace("_t", " *-$", "")).otherwise(F.concat("_t", F.lit(" ")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_p"))), lambda x: x["_p"]), "")
    return rows.withColumn("_p", piece).groupBy("doc_id", "note").agg(F.min("page").alias("page"), F.max("label").alias("label"), collapse_space(text).alias("text"))


def bound(marks: DataFrame, found: DataFrame) -> DataFrame:
    """Marks (doc_id, page, label, ..) with the note that each points at: the first of its label on its page, else on the nearest later one."""
    both = marks.withColumns({"_side": F.lit(1), "_note": F.lit(None).cast("long")}).unionByName(found.select("doc_id", "page", "label", F.lit(0).alias("_side"), F.col("note").alias("_note")), allowMissingColumns=True)
    # From the last page on; on a page marks come after its notes, of which the first is the last one seen.
    w = Window.partitionBy("doc_id", "label").orderBy(F.desc("page"), "_side", F.desc("_note")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("note", F.last("_note", ignorenulls=True).over(w)).filter("_side = 1").select(*marks.columns, "note")
