"""Relational queries of the library, each a function of DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class UnknownModule(LookupError):
    """No module has the code."""


def module_id(modules: DataFrame, code: str) -> int:
    row = modules.filter(F.col("code") == code).select("id").first()
    if row is None:
        raise UnknownModule(code)
    return row["id"]


def chapter_rows(rows: DataFrame, at: dict[str, object], order: list[str]) -> DataFrame:
    """Verses, notes or headings of one chapter; an empty chapter is an empty result."""
    return rows.filter(reduce(Column.__and__, [F.col(c) == v for c, v in at.items()])).orderBy(*order)


def contents(verses: DataFrame, module: list[str], number: str = "verse", text: str = "text") -> DataFrame:
    """Per chapter: text_length in characters and the last verse."""
    return verses.groupBy(*module).agg(F.sum(F.length(text)).cast("long").alias("text_length"), F.max(number).alias("last_verse"))


def inventory(modules: DataFrame, titles: DataFrame, children: dict[str, DataFrame], tagged: DataFrame) -> DataFrame:
    """Per module: code, the overriding title, a count per child table, and whether it has word links.

    Each child is aggregated by module before it is joined, so no two children multiply.
    """
    out = modules.join(titles.withColumnRenamed("title", "_custom"), "code", "left").withColumn("title", F.coalesce("_custom", "title")).drop("_custom")
    for name, rows in children.items():
        out = out.join(rows.groupBy("code").agg(F.count("*").alias(f"n_{name}")), "code", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)).cast("long"))
    flag = tagged.select("code").distinct().withColumn("_tagged", F.lit(True))
    return out.join(flag, "code", "left").withColumn("strongs", F.coalesce("_tagged", F.lit(False))).drop("_tagged").orderBy("code")


def first_tagged(modules: DataFrame, tagged: DataFrame) -> DataFrame:
    return modules.join(tagged.select("code"), "code", "left_semi").agg(F.min("code").alias("code"))


def orphans(children: dict[str, tuple[DataFrame, str]], parents: DataFrame, key: str) -> DataFrame:
    """Rows of each child without a parent."""
    parts = [rows.join(parents, rows[c] == parents[key], "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n") for name, (rows, c) in children.items()]
    return reduce(DataFrame.unionByName, parts)


def neighbours(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds prev and next of the ordering value inside a group; equal values are one position."""
    steps = rows.select(*group, order).distinct()
    w = Window.partitionBy(*group).orderBy(order)
    steps = steps.withColumn("prev", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))
    return rows.join(steps, [*group, order])


def concordance(links: DataFrame, verses: DataFrame, on: list[str], strong: str, value: object, order: list[str], limit: int) -> DataFrame:
    """Occurrences of one word number with their verse; the filter runs before the join, the limit is a top-k."""
    return links.filter(F.col(strong) == value).join(verses, on).orderBy(*order).limit(limit)


def image_sizes(images: DataFrame, group: str) -> DataFrame:
    """Dense by index from 0 to the largest, with (0, 0) in the gaps."""
    slots = images.groupBy(group).agg(F.max("idx").alias("_last")).select(group, F.explode(F.sequence(F.lit(0), F.col("_last").cast("int"))).alias("idx"))
    sized = images.groupBy(group, "idx").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return slots.join(sized, [group, "idx"], "left").select(group, "idx", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"))


def strongs_for_word(links: DataFrame, verses: DataFrame, on: list[str], word: Column) -> DataFrame:
    """Word numbers whose linked bytes hold the word, in the order in which they first occur."""
    from ..functions.text import byte_slice, has_word

    covered = byte_slice(F.col("text"), F.col("start"), F.col("ref_end"))
    return links.join(verses, on).filter(has_word(covered, word)).groupBy(*on, "strong").agg(F.min("seq").alias("seq"))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """seq from 0 per group in reading order."""
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long"))


def prefix_scan(kv: DataFrame, prefix: str) -> DataFrame:
    """Keys from the prefix up to, not including, the prefix followed by the last code point; a pushed-down range."""
    return kv.filter((F.col("key") >= prefix) & (F.col("key") < prefix + "\U0010ffff")).orderBy("key")


def concatenated(rows: DataFrame, key: list[str], pos: str, text: str = "text", keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Duplicates of a key join their texts by one space in input order and keep the first row's other columns."""
    parts = F.array_sort(F.collect_list(F.struct(pos, text)))
    return rows.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p[text]), " ").alias(text), *[F.min_by(c, pos).alias(c) for c in keep_first])


def last_wins(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    """The last row of each key in input order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), pos).alias("_r")).select(*key, "_r.*")


def preview(verses: DataFrame, at: dict[str, object], target: int, last: int) -> DataFrame:
    """Verses from one before the target on, those of the range marked."""
    rows = verses.filter(reduce(Column.__and__, [F.col(c) == v for c, v in at.items()]) & (F.col("verse") >= target - 1))
    return rows.withColumn("marked", F.col("verse").between(target, last)).orderBy("verse")


def overview(marks: DataFrame, canon: DataFrame) -> DataFrame:
    """Decoded annotations without tombstones and undecodable ones, by canon place, then the newest first."""
    shape = "book string, chapter int, verseStart int, verseEnd int, color int, text string, created string"
    rows = marks.filter("value <> ''").withColumn("m", F.from_json("value", shape)).filter("m.book is not null").select("key", "m.*")
    placed = rows.join(F.broadcast(canon.select(F.col("osis").alias("book"), F.col("book").alias("_at"))), "book", "left")  # 66 rows
    return placed.withColumn("place", F.coalesce(F.col("_at").cast("long"), F.lit(4294967295))).drop("_at").orderBy("place", "chapter", "verseStart", F.desc("created"))


def covered(marks: DataFrame, runs: DataFrame, origin: str) -> DataFrame:
    """Runs of text that a mark covers, of the same book and chapter.

    In the module that a mark was made in, its byte offsets bound its first and its last verse; the verses between, and all
    verses of other modules, are covered whole.
    """
    on = (marks.book == runs.book) & (marks.chapter == runs.chapter) & runs.verse.between(marks.verse_start, marks.verse_end)
    before = (runs.verse == marks.verse_start) & (runs.end <= marks.start_offset)
    after = (runs.verse == marks.verse_end) & (runs.start >= marks.end_offset)
    joined = marks.join(runs, on & ((F.col("module") != F.col(origin)) | ~(before | after)))
    return joined.drop(runs.book, runs.chapter)


def note_view(notes: DataFrame, verses: DataFrame, on: list[str]) -> DataFrame:
    """Notes with their mark: a running letter through the chapter by verse, offset and seq, or the verse's number where it has no text."""
    from ..functions.text import marker_label

    known = notes.join(verses.select(*on, F.lit(True).alias("_has")).distinct(), on, "left")
    chapter = [c for c in on if c != "verse"]
    w = Window.partitionBy(*chapter, "_has").orderBy("verse", "offset", "seq")
    label = F.when(F.col("_has"), marker_label(F.row_number().over(w) - 1)).otherwise(F.col("verse").cast("string"))
    return known.withColumn("label", label).drop("_has")


def last_place(located: DataFrame, verses: DataFrame) -> DataFrame:
    """Notes that name (chapter, verse) bound to the last such verse of any book."""
    best = verses.groupBy("chapter", "verse").agg(F.max("book").alias("book"))
    return located.join(best, ["chapter", "verse"])


def selector_rows(spine: DataFrame, capacity: int) -> DataFrame:
    """Chapters of each book dealt into rows of ``capacity``."""
    return spine.withColumn("row", F.expr(f"(row_number() over (partition by book order by chapter) - 1) div {capacity}"))
