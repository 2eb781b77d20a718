"""Block structure from lines: headings, paragraphs, quotations, list items, table rows.

A line is a heading, part of a table or part of a paragraph; some lines take their kind from the line before (a short bold line is
a heading unless a paragraph is open, a line of spread words is a table row unless one is). That is an automaton of five states,
whose steps ``ordered.moves`` composes. Paragraph lines then fall into stretches: after any line that surely closes paragraph and list
(a gap, a short line or another style before it, no indent and no list mark) nothing before matters. A stretch is a paragraph or a list at
most; its lines' measures, not their texts, meet in one list that is folded for margins and list numbers.

Lines: doc_id, pos (0, 1, ..), page, top, left, right, size, bold, italic, cells (left, text). Profile, a row a document: body_size,
body_pitch, body_left, body_right. ``top`` grows downward. Rows with a null doc_id are left out; null flags are false, null measures 0.

Differences to a strictly sequential reading: a table's columns are clusters of all its cells' left edges (6 points), so no table ends
for a row that fits badly, and two running columns set as a table stay one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import list_mark, list_number, without_list_mark
from ..functions.text import collapse_space
from ..session import cut
from .ordered import CHUNK, FOLD, carried, moves

START, HEADING, TABLE, PARAGRAPH, FIRST_ROW = range(5)
#: Points within which cells share a column, and pitches that a gap must exceed.
COLUMN, GAP = 6.0, 1.45


def measures(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """The profile of each document, from counts of different values: body_size carries the most characters (the first larger size by
    characters takes over if it has 40 % as many), body_left is the commonest rounded start of body lines (ties: the smaller),
    body_right the value at 9/10 of their sorted ends, body_pitch the middle distance of consecutive ones on a page.

    Without body lines or distances: right 300 from the left, pitch 1.3 times the size. Null measures count as 0.
    """
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("top", "left", "right")}
    text = F.expr("array_join(transform(cells, c -> coalesce(c.text, '')), '\t')")
    rows = lines.filter("doc_id is not null").select("doc_id", "pos", "page", *zero.values(), F.coalesce("size", F.lit(0.0)).alias("size"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n"))
    rows = rows.withColumn("_s", F.round(F.col("size") * 10).cast("int"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("_s"))
    sizes = rows.groupBy("doc_id", "_s").agg(F.sum("n").alias("n")).withColumns({"_i": F.row_number().over(order), "_top": F.first("_s").over(order), "_most": F.first("n").over(order)})
    body = sizes.groupBy("doc_id").agg(F.coalesce(F.min_by("_s", F.when((F.col("_s") > F.col("_top")) & (F.col("n") * 10 >= F.col("_most") * 4), F.col("_i"))), F.first("_top")).alias("_body"))
    own = rows.join(body, "doc_id").filter(F.abs(F.col("size") - F.col("_body") / 10) < 0.3)
    own = carried(own, ["doc_id"], ["pos"], F.expr(f"pos div {size}"), lag={"_p": F.struct("page", "top")})
    pitch = F.when((F.col("_p.page") == F.col("page")), F.round(F.col("top") - F.col("_p.top"), 6))
    own = own.select("doc_id", F.round("left").alias("left"), "right", F.when((pitch > 0.08 * F.col("_body")) & (pitch < 0.2 * F.col("_body")), pitch).alias("pitch"))
    own = cut(own)
    left = own.groupBy("doc_id", "left").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max_by("left", F.struct("n", -F.col("left"))).alias("_left"))
    right, middle = _place(own, "right", "n * 9 div 10"), _place(own, "pitch", "n div 2")
    found = body.join(left, "doc_id", "left").join(right, "doc_id", "left").join(middle, "doc_id", "left")
    start = F.coalesce("_left", F.lit(0.0))
    return found.select("doc_id", (F.col("_body") / 10).alias("body_size"), F.coalesce("pitch", F.col("_body") / 10 * 1.3).alias("body_pitch"), start.alias("body_left"), F.coalesce("right", start + 300).alias("body_right"))


def _place(rows: DataFrame, value: str, at: str) -> DataFrame:
    """Per document the value at place ``at`` (an expression of n, their number) of its sorted values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy("doc_id", value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy("doc_id")
    upto = counts.withColumns({"_u": F.sum("_c").over(w.orderBy(value)), "n": F.sum("_c").over(w)})
    return upto.filter(F.col("_u") > F.expr(at)).groupBy("doc_id").agg(F.min(value).alias(value))


_TEXT = "array_join(transform(cells, c -> coalesce(c.text, '')), ' ')"


def _measured(lines: DataFrame, profile: DataFrame, size: int) -> DataFrame:
    """What the rules ask of each line by itself and by the line before. Texts stay behind: only what they say goes on."""
    number = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("top", "left", "right", "size")}
    rows = lines.select("doc_id", "pos", "page", *(v.alias(c) for c, v in number.items()), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("bold", "italic")), F.coalesce("cells", F.array().cast("array<struct<left:double,text:string>>")).alias("cells"), F.expr(f"coalesce({_TEXT}, '')").alias("text"))
    text, ended = F.col("text"), F.rtrim("text")
    rows = rows.select(
        "doc_id", "pos", "page", *number, "bold", "italic", F.size("cells").alias("n_cells"), F.expr("if(size(cells) >= 2, transform(slice(cells, 2, size(cells)), c -> c.left), null)").alias("_columns"),
        F.expr(r"forall(cells, c -> size(filter(split(coalesce(c.text, ''), '\\s+'), w -> w <> '')) <= 4)").alias("_brief"), F.trim(text).rlike("^[0-9]*$").alias("digits"), list_mark(text).isNotNull().alias("mark"), list_number(text).alias("number"),
        (F.col("bold") & text.rlike(r"^\s*[0-9]{1,3}\s")).alias("scripture"), ended.rlike("(­|.-)$").alias("_hyphen"), ended.rlike(":$").alias("_colon"), (collapse_space(text) == "").alias("blank"), (collapse_space(without_list_mark(text)) == "").alias("bare"),
    )
    rows = rows.join(profile.select("doc_id", "body_size", "body_pitch", "body_left", "body_right"), "doc_id")
    before = F.struct("page", "top", "right", "size", "bold", "_hyphen", "_colon")
    rows = carried(rows, ["doc_id"], ["pos"], F.expr(f"pos div {size}"), lag={"prev": before}, last={"columns": F.col("_columns")})
    measure = F.col("body_right") - F.col("body_left")
    edge = F.col("body_right") - 0.25 * measure
    turned = F.when((F.col("prev.page") < F.col("page")) & (F.col("prev.right") >= edge), F.col("body_pitch"))
    gap = F.coalesce(F.when(F.col("prev.page") == F.col("page"), F.col("top") - F.col("prev.top")), turned, F.lit(float("inf")))
    rows = rows.withColumn("gap", gap)
    short, larger = (F.col("right") - F.col("left")) < 0.85 * measure, F.col("size") > F.col("body_size") + 0.4
    joins = F.coalesce(F.expr(f"exists(columns, c -> abs(c - left) < {COLUMN})"), F.lit(False)) & (F.col("n_cells") == 1) & (F.col("gap") < GAP * F.col("body_pitch"))
    spread = (F.col("n_cells") >= 2) & (F.col("right") >= F.col("body_right") - F.col("body_size")) & (F.abs(F.col("size") - F.col("body_size")) < 0.3) & F.col("_brief")
    says = lambda c: F.coalesce(F.col(f"prev.{c}"), F.lit(False))
    heading = (larger & (short | F.col("digits"))) | ((F.col("size") > 1.3 * F.col("body_size")) & ~F.col("digits"))
    soft = F.col("bold") & short & ~F.col("digits") & (F.col("n_cells") == 1)
    flags = {
        "mark": F.col("mark"), "scripture": F.col("scripture"), "blank": F.col("blank"), "bare": F.col("bare"), "far": F.col("gap") > GAP * F.col("body_pitch"),
        "restyled": F.coalesce((F.col("prev.bold") != F.col("bold")) & ~F.col("italic") | (F.abs(F.col("prev.size") - F.col("size")) > 0.4), F.lit(False)),
        "after_short": F.coalesce(F.col("prev.right") < edge, F.lit(False)), "after_colon": says("_colon"), "hyphen": says("_hyphen"), "indented": F.col("left") > F.col("body_left") + 0.6 * F.col("body_size"), "is_short": F.col("right") < edge,
    }
    assert tuple(flags) == FLAGS
    bits = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(flags.values())), F.lit(0))
    return rows.select("doc_id", "pos", F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"), "left", "size", "number", "body_size", "body_left", _code(heading, soft, joins, spread).alias("moves"), bits.alias("flags"))


#: What is told of a line, a bit each.
FLAGS = ("mark", "scripture", "blank", "bare", "far", "restyled", "after_short", "after_colon", "hyphen", "indented", "is_short")


def _flag(name: str) -> Column:
    return F.col("flags").bitwiseAND(1 << FLAGS.index(name)) != 0


def _code(heading: Column, soft: Column, joins: Column, spread: Column) -> Column:
    """Next states by the states START, HEADING, TABLE, PARAGRAPH, FIRST_ROW."""
    plain = F.when(heading, "11111").when(soft, "11133").otherwise("33333")
    joined = F.concat(F.substring(plain, 1, 2), F.lit("2"), F.substring(plain, 4, 1), F.lit("2"))
    return F.when(spread, "44232").when(F.col("n_cells") >= 2, "44242").when(joins, joined).otherwise(plain)


def kinds(lines: DataFrame, profile: DataFrame, size: int = CHUNK) -> DataFrame:
    """Measured lines with ``kind`` (HEADING, TABLE or PARAGRAPH), ``was``, the kind of the line before (or START), and ``lone``.

    A table of one row is a paragraph's line that lies alone.
    """
    rows = cut(_measured(lines, profile, size))
    slim = moves(rows.select("doc_id", "pos", F.col("moves").alias("_moves")), ["doc_id"], "pos", "_moves", "_was", START, max(2, min(size, FOLD)))
    slim = slim.withColumn("_kind", F.expr("int(substring(_moves, _was + 1, 1))")).withColumn("_back", -F.col("pos"))
    slim = carried(slim, ["doc_id"], ["_back"], F.expr(f"-(pos div {size})"), lag={"_next": F.col("_kind")})  # from the far end: the line after
    lone = (F.col("_kind") == FIRST_ROW) & (F.coalesce("_next", F.lit(START)) != TABLE)
    kind = F.when(lone, PARAGRAPH).when(F.col("_kind") == FIRST_ROW, TABLE).otherwise(F.col("_kind"))
    was = F.when((F.col("_was") == FIRST_ROW) & (F.col("_kind") != TABLE), PARAGRAPH).when(F.col("_was") == FIRST_ROW, TABLE).otherwise(F.col("_was"))
    return rows.drop("moves").join(slim.select("doc_id", "pos", kind.alias("kind"), was.alias("was"), lone.alias("lone")), ["doc_id", "pos"])


#: What a paragraph line does: goes on, or opens a paragraph, a quotation, an item, an item of a new list, a paragraph inside an item.
GOES_ON, OPENS, QUOTES, ITEM, NEW_LIST, INSIDE = range(6)


def _fold() -> str:
    """Steps of a stretch's lines: margins of the open paragraph, the list's kind and items, and a character a line."""
    x = {n: f"x.{n}" for n in ("left", "mark", "number", "sure", "indented", "body", "size")}
    back = f"(s.list > 0 and abs({x['left']} - s.first) < 1.0 and {x['left']} < s.margin)"
    following = f"(s.list = 2 and {x['number']} is not null and {x['number']} = s.items + 1)"
    item = f"({x['mark']} and (s.first is null or x.evidence or {back} or {following}))"
    indent = f"({x['indented']} and s.list = 0 and not s.quote and {x['left']} < {x['body']} + 3.0 * {x['size']} and {x['left']} > s.margin + 0.6 * {x['size']})"
    opens = f"(s.first is null or (not x.hyphen and ({x['sure']} or {item} or {indent})))"
    goes = f"((s.list = 2 and {x['number']} = s.items + 1) or (s.list = 1 and {x['number']} is null))"
    quote = f"({x['indented']} and s.list = 0 and {x['left']} > {x['body']} + 3.0 * {x['size']} and not x.scripture)"
    code = f"case when not {opens} then '{GOES_ON}' when {item} and coalesce({goes}, false) then '{ITEM}' when {item} then '{NEW_LIST}' when {quote} then '{QUOTES}' when s.list > 0 and x.indented then '{INSIDE}' else '{OPENS}' end"
    named = "named_struct('first', {first}, 'margin', {margin}, 'quote', {quote}, 'list', {list}, 'items', {items}, 'out', {out})"
    step = named.format(
        first="if(c = '0', s.first, x.left)", margin="case when c <> '0' then x.left when x.left > s.first + 0.5 then x.left else s.margin end", quote="if(c = '0', s.quote, c = '2')",
        list="case when c = '4' then if(x.number is null, 1, 2) when c in ('1', '2') then 0 else s.list end", items="case when c = '4' then 1 when c = '3' then s.items + 1 else s.items end", out="concat(s.out, c)",
    )
    start = named.format(first="cast(null as double)", margin="cast(null as double)", quote="false", list="0", items="0", out="''")
    return f"aggregate(_lines, {start}, (s, x) -> get(transform(array({code}), c -> {step}), 0), s -> s.out)"


def _steps(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, pos and ``step`` of the paragraph lines."""
    mark, indented = _flag("mark") & ~F.col("lone"), _flag("indented") & ~F.col("lone")
    sure = _flag("far") | _flag("restyled") | _flag("after_short")
    slim = rows.filter(F.col("kind") == PARAGRAPH).select(
        "doc_id", "pos", "left", mark.alias("mark"), F.when(mark, F.col("number")).alias("number"), sure.alias("sure"), (_flag("far") | _flag("after_short") | indented | _flag("after_colon")).alias("evidence"),
        indented.alias("indented"), (_flag("hyphen") & ~F.col("lone")).alias("hyphen"), _flag("scripture").alias("scripture"), F.col("body_left").alias("body"), F.col("body_size").alias("size"),
        ((F.col("was") != PARAGRAPH) | F.col("lone") | (sure & ~_flag("hyphen") & ~mark & ~indented)).cast("long").alias("_new"),
    )
    slim = carried(slim, ["doc_id"], ["pos"], F.expr(f"pos div {size}"), total={"_stretch": F.col("_new")}).withColumn("_stretch", F.col("_stretch") + F.col("_new"))
    fields = [c for c in slim.columns if c not in ("doc_id", "_new", "_stretch")]
    packed = slim.groupBy("doc_id", "_stretch").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_lines"))
    found = packed.withColumn("_out", F.expr(_fold())).select("doc_id", F.posexplode("_lines.pos").alias("_i", "pos"), "_out")
    return found.select("doc_id", "pos", F.expr("int(substring(_out, _i + 1, 1))").alias("step"))


def _texts(lines: DataFrame, own: DataFrame) -> DataFrame:
    """Texts of blocks from their lines (doc_id, pos, block, kind). A soft hyphen at a line's end goes, a hard one before a small letter, and
    neither leaves a space; lines of a heading are parted by spaces, and an item's mark is cut off."""
    rows = lines.select("doc_id", "pos", F.expr(f"coalesce({_TEXT}, '')").alias("text")).join(own, ["doc_id", "pos"])
    rows = rows.withColumn("text", F.when(F.col("kind") == "item", without_list_mark(F.col("text"))).otherwise(F.col("text")))
    text, following = F.rtrim("text"), F.lead("text").over(Window.partitionBy("doc_id", "block").orderBy("pos"))
    soft, hard, plain = text.rlike("­$"), text.rlike(".-$"), F.col("kind") == "heading"
    piece = F.when(following.isNull() & ~plain, text).when(plain, F.concat("text", F.lit(" "))).when(soft, F.regexp_replace(text, "­$", "")).when(hard & following.rlike(r"^\p{Ll}"), F.regexp_replace(text, " *-$", "")).when(hard, text).otherwise(F.concat(text, F.lit(" ")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_piece"))), lambda x: x["_piece"]), "")
    return rows.withColumn("_piece", piece).groupBy("doc_id", "block").agg(collapse_space(whole).alias("text")).withColumnRenamed("block", "pos")


def blocks(lines: DataFrame, profile: DataFrame, size: int = CHUNK) -> DataFrame:
    """doc_id, pos (first line), page, kind (heading, paragraph, item, table), style (body, quote, scripture, poetry), level, list (first line
    of its list), n_lines, text. A table has no text here; ``tables`` has its cells. ``size`` lines are a chunk; the result does not depend on it."""
    rows, chunk = cut(kinds(lines, profile, size).drop("body_right")), F.expr(f"pos div {size}")
    opens, item = F.col("step") != GOES_ON, F.col("step").isin(ITEM, NEW_LIST)
    steps = cut(_steps(rows, size))
    steps = carried(steps, ["doc_id"], ["pos"], chunk, last={"_own": F.when(opens, F.col("pos")), "_of": F.when(F.col("step") == NEW_LIST, F.col("pos"))})
    steps = steps.select("doc_id", "pos", "step", F.when(opens, F.col("pos")).otherwise(F.col("_own")).alias("block"), F.when(F.col("step") == NEW_LIST, F.col("pos")).when(F.col("step").isin(ITEM, INSIDE), F.col("_of")).alias("list"))
    blank = F.when(item, _flag("bare")).otherwise(_flag("blank"))
    steps = rows.select("doc_id", "pos", "page", "flags").join(steps, ["doc_id", "pos"]).withColumn("_blank", blank.cast("int"))
    head = F.min_by(F.struct("page", "step", "list", _flag("is_short").alias("is_short"), _flag("scripture").alias("scripture")), "pos")
    made = steps.groupBy("doc_id", F.col("block").alias("pos")).agg(F.count("*").alias("n_lines"), F.min("_blank").alias("_blank"), head.alias("_h")).filter("_blank = 0")
    style = F.when(F.col("_h.scripture"), "scripture").when(F.col("_h.step") == QUOTES, "quote").otherwise("body")
    single = F.col("_h.list").isNull() & (style == "body") & (F.col("n_lines") == 1) & F.col("_h.is_short")
    kind = F.when(F.col("_h.step").isin(ITEM, NEW_LIST), "item").otherwise("paragraph")
    made = made.select("doc_id", "pos", F.col("_h.page").alias("page"), kind.alias("kind"), style.alias("style"), F.lit(None).cast("int").alias("level"), F.col("_h.list").alias("list"), "n_lines", single.alias("_single"))
    heads, head_lines = _headings(rows, chunk)
    grids = rows.filter((F.col("kind") == TABLE) & (F.col("was") != TABLE)).select("doc_id", "pos", "page", F.lit("table").alias("kind"))
    both = cut(made.unionByName(heads).unionByName(grids, allowMissingColumns=True))
    # Runs of single short lines are set as they stand.
    flags = carried(both, ["doc_id"], ["pos"], chunk, lag={"_a": F.col("_single")})
    flags = carried(flags.withColumn("_back", -F.col("pos")), ["doc_id"], ["_back"], F.expr(f"-(pos div {size})"), lag={"_z": F.col("_single")})
    poetry = F.coalesce("_single", F.lit(False)) & (F.coalesce("_a", F.lit(False)) | F.coalesce("_z", F.lit(False)))
    found = flags.withColumn("style", F.when(poetry, "poetry").otherwise(F.col("style"))).select("doc_id", "pos", "page", "kind", "style", "level", "list", "n_lines")
    own = steps.select("doc_id", "pos", "block", F.when(item, "item").otherwise("paragraph").alias("kind")).unionByName(head_lines)
    return found.join(_texts(lines, own), ["doc_id", "pos"], "left")


def _headings(rows: DataFrame, chunk: Column) -> tuple[DataFrame, DataFrame]:
    """Headings with levels by rank of size, at most 6, and their lines; consecutive lines of one size are one heading."""
    heads = rows.filter(F.col("kind") == HEADING).select("doc_id", "pos", "page", F.round(F.col("size") * 10).cast("int").alias("_size"))
    sizes = heads.select("doc_id", "_size").distinct()
    levels = sizes.withColumn("level", F.least(F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("_size"))), F.lit(6)))
    heads = carried(heads, ["doc_id"], ["pos"], chunk, lag={"_p": F.struct("pos", "_size")})
    goes = (F.col("_p.pos") == F.col("pos") - 1) & (F.col("_p._size") == F.col("_size"))
    heads = heads.withColumn("_new", F.when(~F.coalesce(goes, F.lit(False)), F.col("pos")))
    heads = carried(heads, ["doc_id"], ["pos"], chunk, last={"_of": F.col("_new")}).withColumn("_of", F.coalesce("_new", "_of"))
    heads = cut(heads.select("doc_id", "pos", "page", "_size", "_of"))
    made = heads.join(levels, ["doc_id", "_size"]).groupBy("doc_id", F.col("_of").alias("pos")).agg(F.min("page").alias("page"), F.first("level").alias("level"), F.count("*").alias("n_lines"))
    made = made.select("doc_id", "pos", "page", F.lit("heading").alias("kind"), F.lit(None).cast("string").alias("style"), "level", F.lit(None).cast("long").alias("list"), "n_lines", F.lit(False).alias("_single"))
    return made, heads.select("doc_id", "pos", F.col("_of").alias("block"), F.lit("heading").alias("kind"))


def tables(lines: DataFrame, profile: DataFrame, size: int = CHUNK) -> DataFrame:
    """Table cells: doc_id, pos (the table's first line), row, col, text, all numbered from 0.

    Left edges of a table's cells that follow each other within six points are one column. A line that leaves the first column
    empty goes on with the row above.
    """
    rows = kinds(lines, profile, size).filter(F.col("kind") == TABLE)
    chunk = F.expr(f"pos div {size}")
    rows = carried(rows.withColumn("_new", F.when(F.col("was") != TABLE, F.col("pos"))), ["doc_id"], ["pos"], chunk, last={"_of": F.col("_new")}).withColumn("table", F.coalesce("_new", "_of"))
    rows = rows.select("doc_id", "pos", "table").join(lines.select("doc_id", "pos", "cells"), ["doc_id", "pos"])
    cells = rows.select("doc_id", "table", "pos", F.posexplode("cells").alias("i", "c")).select("doc_id", "table", "pos", "i", "c.left", F.coalesce("c.text", F.lit("")).alias("text"))
    edges = cells.select("doc_id", "table", "left").distinct()
    w = Window.partitionBy("doc_id", "table").orderBy("left")
    edges = edges.withColumn("_n", (F.col("left") - F.lag("left").over(w) >= COLUMN).cast("int")).withColumn("col", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("int")).drop("_n")
    placed = cells.join(edges, ["doc_id", "table", "left"])
    heads = placed.groupBy("doc_id", "table", "pos").agg((F.min("col") == 0).cast("long").alias("_opens"))
    numbered = carried(heads, ["doc_id", "table"], ["pos"], chunk, total={"_rows": F.col("_opens")}).select("doc_id", "table", "pos", F.greatest(F.lit(0), F.col("_rows") + F.col("_opens") - 1).cast("int").alias("row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "i", "text"))), lambda x: x["text"]), " ")
    made = placed.join(numbered, ["doc_id", "table", "pos"]).groupBy("doc_id", "table", "row", "col").agg(collapse_space(text).alias("text"))
    return made.select("doc_id", F.col("table").alias("pos"), "row", "col", "text")
