"""Lines of a page from placed fragments of text: baselines, raised marks, word and cell gaps.

Fragments on a page belong to the line of the first one whose baseline is within a tolerance of their own: a chain of firsts, each the
next baseline beyond the tolerance. Where baselines lie apart by more than that they part lines whatever was before, and a stretch
no higher than the tolerance is one line; only wider stretches need the chain, which ``ordered.chain`` doubles. What else a line
needs comes from its own fragments in order of x.

Fragments: doc_id, page, x, y (of the raised text, downward), rise, width, size, bold, italic, text. Places are compared in hundredths
of a point. A null doc_id or page belongs to no page; null measures count as 0, null flags as false; fragments without text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import LIGATURES, mark_label, without_ligatures
from ..functions.text import collapse_space
from ..session import cut
from .ordered import chain

#: Hundredths of a point between baselines of a line; spaces that part table cells.
TOLERANCE, CELL_SPACES = 150, 2.5
PAGE = ("doc_id", "page")


def baselines(fragments: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Fragments with ``q``, their baseline in hundredths of a point, and ``group``, the number of their baseline group on the page."""
    number = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("x", "y", "rise", "width", "size")}
    rows = fragments.filter("doc_id is not null and page is not null and text <> ''").select(*PAGE, *number.values(), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("bold", "italic")), "text")
    rows = rows.withColumn("q", F.round(100 * (F.col("y") + F.col("rise"))).cast("long"))
    w = Window.partitionBy(*PAGE).orderBy("q", "x", "text", "width", "size", "bold", "italic")
    rows = rows.withColumns({"at": F.row_number().over(w), "_apart": F.coalesce((F.col("q") - F.lag("q").over(w) > tolerance).cast("int"), F.lit(1))})
    rows = cut(rows.withColumn("_island", F.sum("_apart").over(w)))
    spans = rows.groupBy(*PAGE, "_island").agg((F.max("q") - F.min("q")).alias("_high"))
    wide = rows.join(spans.filter(F.col("_high") > tolerance), [*PAGE, "_island"])
    beyond = Window.partitionBy(*PAGE, "_island").orderBy(F.desc("q")).rangeBetween(Window.unboundedPreceding, -(tolerance + 1))
    wide = wide.withColumn("_next", F.min("at").over(beyond))
    firsts = chain(wide, [*PAGE, "_island"], "at", "_next").select(*PAGE, "at", F.lit(1).alias("_first"))
    marked = rows.join(firsts, [*PAGE, "at"], "left")
    opens = F.greatest(F.col("_apart"), F.coalesce("_first", F.lit(0)))
    return marked.withColumn("group", F.sum(opens).over(Window.partitionBy(*PAGE).orderBy("at"))).drop("_apart", "_island", "_first")


def folded(rows: DataFrame) -> DataFrame:
    """``baselines`` with ``line``: a group of nothing but small raised marks joins the group just below, its rise grows by the distance."""
    bare = F.regexp_replace(F.trim("text"), "[,.;:)]+$", "")
    mark = bare.rlike("^([0-9*)]+|[a-z])$")
    groups = rows.groupBy(*PAGE, "group").agg(F.min(mark.cast("int")).alias("_marks"), F.max("size").alias("_size"), F.min_by("q", "at").alias("_q"))
    w = Window.partitionBy(*PAGE).orderBy("group")
    below = F.lead(F.struct("_size", "_q")).over(w)
    groups = groups.withColumn("_below", below)
    lift = (F.col("_below._q") - F.col("_q")) / 100
    joins = (F.col("_marks") == 1) & (F.col("_size") < 0.8 * F.col("_below._size")) & (lift > 0) & (lift < 0.7 * F.col("_below._size"))
    target = F.when(~F.coalesce(joins, F.lit(False)), F.struct("group", "_q"))
    onward = Window.partitionBy(*PAGE).orderBy(F.desc("group")).rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("_to", F.last(target, ignorenulls=True).over(onward)).select(*PAGE, "group", F.col("_to.group").alias("line"), F.col("_to._q").alias("_base"), ((F.col("_to._q") - F.col("_q")) / 100).alias("_lift"))
    return rows.join(groups, [*PAGE, "group"]).withColumn("rise", F.col("rise") + F.col("_lift")).drop("_lift", "group")


def _punctuation(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(r"^[!-/:-@\[-`{-~–»«’]+$") & ~t.rlike(r"^[(»„\[]")


def lines(fragments: DataFrame, tolerance: int = TOLERANCE, cell_spaces: float = CELL_SPACES) -> DataFrame:
    """doc_id, page, line (from 0), top, left, right, size, bold, italic, cells (left, text), text (cells parted by tabs), marks (labels of raised
    runs). Size and style are those of most characters that are not raised. A gap above 0.15 sizes, plus the middle letter gap where the
    line is set with tracking, is a space; one of ``cell_spaces`` spaces begins a cell; neither stands before lone punctuation."""
    rows = folded(baselines(fragments, tolerance))
    own, key = Window.partitionBy(*PAGE, "line"), (*PAGE, "line")
    order = own.orderBy("x", "at")
    base = F.when(F.abs("rise") <= 0.5, F.length("text"))
    styles = rows.select(*key, F.struct(F.round(F.col("size") * 10).cast("int").alias("s"), "bold", "italic").alias("style"), base.alias("n"), "x", "at")
    counted = styles.filter("n is not null").groupBy(*key, "style").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.max_by("style", F.struct("n", "style")).alias("_most"))
    first = styles.groupBy(*key).agg(F.min_by("style", F.struct("x", "at")).alias("_any"))
    style = first.join(counted, list(key), "left").select(*key, F.coalesce("_most", "_any").alias("_style"))
    rows = rows.join(style, list(key)).withColumn("_size", F.col("_style.s") / 10)
    following = F.lead(F.struct("x", "text")).over(order)
    rows = rows.withColumns({"_f": following, "_before": F.lag("text").over(order)})
    over = (F.col("_f.x") > F.col("x")) & (F.col("x") + F.col("width") > F.col("_f.x") + 0.05)
    rows = rows.withColumn("width", F.when(over, F.col("_f.x") - F.col("x")).otherwise(F.col("width")))
    gap = F.round(F.col("_f.x") - F.col("x") - F.col("width"), 4)
    letter = F.when((F.trim("text") != "") & ~F.startswith(F.col("_f.text"), F.lit(" ")) & (gap > 0), gap)
    rows = rows.withColumns({"_end": F.lag(F.col("x") + F.col("width")).over(order), "_letter": letter})
    # A line's fragments are as many as paper has room for, so their gaps meet in a list.
    gaps = F.array_sort(F.collect_list("_letter").over(own))
    rows = rows.withColumns({"_gaps": gaps, "_m": F.count("*").over(own)})
    middle, space = F.get("_gaps", F.expr("int(size(_gaps) div 2)")), 0.25 * F.col("_size")
    tracking = F.when((F.size("_gaps") >= 8) & (2 * F.size("_gaps") >= F.col("_m")) & (middle < space), middle).otherwise(0.0)
    apart = F.round(F.col("x") - F.col("_end"), 4)
    plain = F.col("_end").isNotNull() & ~_punctuation(F.col("text"))
    cell = F.coalesce(plain & (apart > cell_spaces * space), F.lit(False))
    word = F.coalesce(plain & (apart > 0.6 * space + tracking), F.lit(False))
    last = F.col("_f").isNull()
    text = F.when(last, F.concat(F.regexp_replace(F.rtrim("text"), "­", ""), F.when(F.rtrim("text").endswith("­"), "­").otherwise(""))).otherwise(F.regexp_replace("text", "­", ""))
    after = F.rtrim("_before").rlike(f"({'|'.join(LIGATURES)})$") & text.rlike(r"^ +\p{Ll}")
    text = without_ligatures(F.when(F.coalesce(after, F.lit(False)), F.ltrim(text)).otherwise(text))
    lone = F.trim("text").rlike("^[a-z]$")
    raised = (F.col("rise") > 0.5) | (F.col("size") < 0.8 * F.col("_size")) & (F.col("italic") & lone | (F.col("q") < F.col("_base") - 50))
    rows = rows.withColumns({"_new": cell.cast("int"), "_t": F.when(word & ~cell, F.concat(F.lit(" "), text)).otherwise(text), "_mark": F.when(raised, F.nullif(mark_label(F.col("text")), F.lit("")))})
    rows = rows.withColumn("_cell", F.sum("_new").over(order))
    made = rows.groupBy(*key, "_cell").agg(
        F.min("x").alias("left"), F.max_by(F.col("x") + F.col("width"), F.struct("x", "at")).alias("right"), collapse_space(_joined("_t", "")).alias("text"), F.array_sort(F.collect_list(F.when(F.col("_mark").isNotNull(), F.struct("x", "at", "_mark")))).alias("_marks"), F.first("_style").alias("_style"), F.first("_base").alias("_base"),
    ).filter("text <> ''")
    cells = F.array_sort(F.collect_list(F.struct("left", "text", "right", "_marks")))
    made = made.groupBy(*key).agg(cells.alias("_c"), F.first("_style").alias("_style"), F.first("_base").alias("_base"))
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line")) - 1
    return made.select(
        *PAGE, number.alias("line"), (F.col("_base") / 100).alias("top"), F.expr("get(_c, 0).left").alias("left"), F.expr("element_at(_c, -1).right").alias("right"), (F.col("_style.s") / 10).alias("size"), F.col("_style.bold").alias("bold"), F.col("_style.italic").alias("italic"),
        F.expr("transform(_c, c -> struct(c.left, c.text))").alias("cells"), F.expr("array_join(_c.text, '\\t')").alias("text"), F.expr("flatten(transform(_c, c -> c._marks._mark))").alias("marks"),
    )


def _joined(column: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "at", column))), lambda p: p[column]), between)
