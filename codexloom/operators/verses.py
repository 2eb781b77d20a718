"""Verse segmentation: numbered verses from paragraphs, as a dataflow without an automaton.

What a number means depends on the chapter and verse before it and on text that waits for a number. All of it is a last value
or a sum over what came before: a number sets the verse by itself, whatever was before it, and moves the chapter on by one or by none.
So the state is carried by ``ordered.carried``, and a document of any length is cut wherever it suits.

Input: parts (doc_id, pos, part, kind, book, chapter, number, text). Kind ``start`` opens a chapter; ``title`` is a section heading;
``text`` is a piece of paragraph ``pos``, ``number`` the verse number that stands before it (1 or more), if any.

- Before a chapter's first number, a text that begins with a number is numbered by it, and the chapter's own number means verse 1.
- A 1 after verses opens the next chapter, and so does a 2 or 3 below the last verse when text without a number waits.
- Waiting text becomes verse 1 where a chapter's first number is 2 or more; else it goes on with the verse before it. A chapter's pieces
  before its first number wait together; after verses a piece joins the one that waits if that has no final stop or it begins small.
- Titles belong to the next verse of their chapter. Text before all verses, and before the first start, is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_space
from ..session import cut
from .ordered import CHUNK, carried

_STOP = r"[.!?:;«»\"]\s*$"


def parts_of(blocks: DataFrame) -> DataFrame:
    """Parts of blocks (doc_id, pos, kind, book, chapter, text, marks): a paragraph is cut at its marks (at, number), a heading
    with a chapter is a start, another one a title. Places count characters from 0, in ascending order."""
    cut_at = "concat(array(struct(0 as at, cast(null as int) as number)), coalesce(transform(marks, m -> struct(int(m.at) as at, int(m.number) as number)), array()))"
    pieces = blocks.withColumn("_m", F.when(F.col("kind") == "paragraph", F.expr(cut_at)).otherwise(F.expr("array(struct(0 as at, cast(null as int) as number))")))
    pieces = pieces.select("*", F.posexplode("_m").alias("part", "_p"))
    text = F.expr("substring(text, _p.at + 1, coalesce(get(_m, part + 1).at, length(text)) - _p.at)")
    kind = F.when(F.col("kind") == "paragraph", "text").when(F.col("chapter").isNotNull(), "start").otherwise("title")
    return pieces.select("doc_id", "pos", "part", kind.alias("kind"), F.when(kind == "start", F.col("book")).alias("book"), F.when(kind == "start", F.col("chapter")).alias("chapter"), F.col("_p.number").alias("number"), text.alias("text"))


def _numbered(parts: DataFrame, size: int) -> DataFrame:
    """Parts inside chapters with their start's number, book and chapter, the number that each has in the end, and what its text says.

    Texts stay behind; ``cut`` tells how many characters of a number to take off when they are joined again."""
    text = F.trim(F.coalesce("text", F.lit("")))
    start, lead = F.col("kind") == "start", F.regexp_extract(text, "^([0-9]{1,3}) ", 1)
    body = F.when((F.col("kind") == "text") & F.col("number").isNull() & (lead != ""), F.length(lead))
    rows = parts.select("doc_id", "pos", "part", "kind", "book", "chapter", "number", F.when(body.isNotNull(), lead.cast("int")).alias("_lead"), body.alias("_digits"), (text == "").alias("_empty"), (~text.rlike(_STOP)).alias("open_end"), text.rlike(r"^\p{Ll}").alias("small"))
    rows = rows.filter("kind <> 'text' or number is not null or not _empty")
    rows = carried(
        rows, ["doc_id"], ["pos", "part"], F.expr(f"pos div {size}"),
        last={"_place": F.when(start, F.struct("book", "chapter")), "_fresh": F.when(start, True).when((F.col("kind") == "text") & F.coalesce("number", "_lead").isNotNull(), False)},
        total={"_start": start.cast("long")},
    )
    rows = rows.filter(~start & (F.col("_place.chapter") > 0))
    taken = F.col("_fresh") & F.col("_lead").isNotNull()
    n = F.when(taken, F.greatest(F.lit(1), F.when(F.col("_lead") == F.col("_place.chapter"), 1).otherwise(F.col("_lead")))).otherwise(F.greatest(F.lit(1), F.col("number")))
    return rows.select("doc_id", "pos", "part", "kind", "_start", F.col("_place.book").alias("book"), F.col("_place.chapter").alias("first"), F.when(F.col("number").isNotNull() | taken, n).alias("number"), F.when(taken, F.col("_digits")).otherwise(0).alias("cut"), "open_end", "small")


def verses(parts: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Verses (doc_id, ordinal, book, chapter, verse, paragraph, text) in order, and titles (doc_id, ordinal, seq, text) by the verse
    that they stand before. ``size`` paragraphs are a chunk; the result does not depend on it."""
    chunk = F.expr(f"pos div {size}")
    rows = cut(_numbered(parts, size))
    numbered, waits = F.col("number").isNotNull(), (F.col("kind") == "text") & F.col("number").isNull()
    rows = carried(
        rows, ["doc_id", "_start"], ["pos", "part"], chunk,
        last={"_verse": F.col("number"), "_held": F.when(numbered, F.lit(-1)).when(waits, F.col("open_end").cast("int")), "_begun": F.when(numbered | waits, F.col("pos"))},
    )
    verse, held = F.coalesce("_verse", F.lit(0)), F.coalesce(F.col("_held") >= 0, F.lit(False))
    rolls = numbered & (verse >= 2) & (F.col("number") < verse) & (F.col("number") <= 3) & held
    said = (numbered, waits, numbered & (F.col("number") >= 2) & held & ((verse == 0) | rolls), numbered & ~F.coalesce(F.col("_begun") == F.col("pos"), F.lit(False)), waits & ~(held & ((verse == 0) | (F.col("_held") == 1) | F.col("small"))))
    bits = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(said)), F.lit(0))
    step = (numbered & (verse > 0) & (F.col("number") == 1) | rolls).cast("int")
    rows = rows.select("doc_id", "pos", "part", "_start", "book", "first", "number", "cut", F.coalesce(step, F.lit(0)).alias("_step"), bits.alias("_bits"))
    numbered, waits, opens, flag, apart = (F.col("_bits").bitwiseAND(1 << i) != 0 for i in range(5))
    rows = carried(rows, ["doc_id", "_start"], ["pos", "part"], chunk, total={"_moved": F.col("_step")})
    rows = rows.select("doc_id", "pos", "part", "_start", "book", (F.col("first") + F.col("_moved") + F.col("_step")).cast("int").alias("chapter"), "number", "cut", "_bits")
    rows = cut(carried(rows, ["doc_id"], ["pos", "part"], chunk, total={"_n": numbered.cast("long"), "_group": apart.cast("int")}))
    own = rows.filter(numbered)
    heads = own.select("doc_id", (2 * F.col("_n") + 3).alias("ordinal"), "book", "chapter", F.col("number").alias("verse"), flag.alias("paragraph"))
    opened = own.filter(opens).select("doc_id", (2 * F.col("_n") + 2).alias("ordinal"), "book", "chapter", F.lit(1).alias("verse"), F.lit(True).alias("paragraph"), "_group")
    pieces = rows.filter(waits).withColumn("_group", F.col("_group") + apart.cast("int"))
    pieces = pieces.join(opened.select("doc_id", "_group", F.col("ordinal").alias("_to")), ["doc_id", "_group"], "left")
    pieces = pieces.select("doc_id", F.coalesce("_to", 2 * F.col("_n") + 1).alias("ordinal"), "pos", "part", "cut").filter("ordinal > 1")
    pieces = pieces.unionByName(own.select("doc_id", (2 * F.col("_n") + 3).alias("ordinal"), "pos", "part", "cut"))
    whole = parts.filter("kind = 'text'").select("doc_id", "pos", "part", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    texts = pieces.join(whole, ["doc_id", "pos", "part"]).withColumn("text", collapse_space(F.expr("substring(text, cut + 1)"))).filter("text <> ''")
    joined = texts.groupBy("doc_id", "ordinal").agg(_joined("pos", "part", "text").alias("text"))
    found = heads.unionByName(opened.drop("_group")).join(joined, ["doc_id", "ordinal"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    found = found.select("doc_id", "ordinal", "book", "chapter", "verse", "paragraph", "text")
    # A title's verse: the next number of its chapter's start, or the verse 1 that this number opens.
    titles = rows.filter(~numbered & ~waits).select("doc_id", "_start", "_n", "pos", "part")
    titles = titles.join(parts.filter("kind not in ('text', 'start')").select("doc_id", "pos", "part", F.trim(F.coalesce("text", F.lit(""))).alias("text")), ["doc_id", "pos", "part"])
    to = own.select("doc_id", "_start", "_n", (2 * F.col("_n") + F.when(opens, 2).otherwise(3)).alias("ordinal"))
    seq = F.row_number().over(Window.partitionBy("doc_id", "ordinal").orderBy("pos", "part"))
    return found, titles.join(to, ["doc_id", "_start", "_n"]).select("doc_id", "ordinal", seq.alias("seq"), "text")


def _joined(*columns: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(*columns)))
    return F.array_join(F.transform(ordered, lambda x: x[columns[-1]]), " ")
