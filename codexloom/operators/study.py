"""Reading desk queries: contents in the reader's language, look-ups and their anchors, footnotes with references, lists by kind."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import references as refs
from .library import concordance, first_tagged, note_view

KINDS = ("bible", "commentary", "dictionary", "book", "devotional")
# The marks that panes are told apart by, in order.
BADGES = "123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def book_names(spark: SparkSession) -> DataFrame:
    """book, osis, english, german, abbrev, category index: a dimension of fixed size."""
    from ..schema import CATEGORIES

    kind = lambda i: next(k for k, (last, _) in enumerate(CATEGORIES) if i <= last)
    rows = [(i, osis, english, german, short, kind(i)) for i, (osis, english, german, short, _) in enumerate(refs.ROWS)]
    return spark.createDataFrame(rows, "book int, osis string, english string, german string, abbrev string, category int")


def localized_spine(spine: DataFrame, language: Column) -> DataFrame:
    """Chapters with their book's name in German or English, its short form and category."""
    names = F.broadcast(book_names(spine.sparkSession))  # 66 rows
    return spine.join(names, "book", "left").withColumn("name", F.when(F.lower(language).startswith("de"), F.col("german")).otherwise(F.col("english"))).drop("english", "german")


def table_of_contents(sections: DataFrame) -> DataFrame:
    return sections.select("ordinal", "level", "name").orderBy("ordinal")


def plans_by_name(plans: DataFrame) -> DataFrame:
    return plans.orderBy("name")


def modules_of_kind(modules: DataFrame) -> DataFrame:
    """Per kind its modules' codes in order; kinds without a module are empty."""
    kinds = modules.sparkSession.createDataFrame([(i, k) for i, k in enumerate(KINDS)], "place int, kind string")
    own = modules.groupBy("kind").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return kinds.join(own, "kind", "left").select("place", "kind", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def chapter_of(verses: DataFrame, reference: Column, names: refs.Names | None = None) -> DataFrame:
    """Verses (book, chapter, verse ..) of the chapter that a reference lies in. One reference, or a column of them as ``reference``."""
    spark = verses.sparkSession
    osis = spark.range(1).select(refs.parse_udf(names or refs.built_in())(reference).alias("r")).select(F.split("r.osis", r"[.\-]").alias("p"))
    place = osis.select(F.get("p", F.lit(0)).alias("osis"), F.get("p", F.lit(1)).cast("int").alias("chapter")).join(book_names(spark).select("osis", "book"), "osis").select("book", "chapter")
    return verses.join(F.broadcast(place), ["book", "chapter"]).orderBy("verse")  # one row


def concordance_of(links: DataFrame, verses: DataFrame, modules: DataFrame, strong: str, limit: int) -> DataFrame:
    """A word number's places in the first tagged module, in canon order; all tables carry the module's ``code``."""
    first = F.broadcast(first_tagged(modules, links))  # one row
    on = ["code", "book", "chapter", "verse"]
    return concordance(links.join(first, "code", "left_semi"), verses, on, "strong", strong, [*on[1:], "seq"], limit)


def chapter_notes(notes: DataFrame, verses: DataFrame, names: refs.Names | None = None) -> DataFrame:
    """Notes (book, chapter, verse, seq, offset, text) with their label, and the references in their text, relative to the note's chapter."""
    osis = F.broadcast(book_names(notes.sparkSession).select("book", "osis"))  # 66 rows
    viewed = note_view(notes, verses, ["book", "chapter", "verse"]).join(osis, "book", "left")
    return viewed.withColumn("refs", refs.scan_udf(names or refs.built_in())("text", "osis", "chapter")).drop("osis")


def entry_anchor(anchor: Column) -> Column:
    """The entry number of ``G26``, ``26`` or ``00026``."""
    t = F.trim(anchor)
    return F.when(t.rlike(r"^[Gg]?[0-9]+$"), F.regexp_extract(t, r"([0-9]+)$", 1).try_cast("long"))


def anchor_after(anchor: Column, sign: str) -> Column:
    """What follows ``q:`` (a search), ``c:`` (a concordance), ``s:`` (a section) or ``d:`` (a day)."""
    return F.when(F.startswith(anchor, F.lit(f"{sign}:")), F.substring(anchor, F.lit(len(sign) + 2), F.length(anchor)))


def lookup_anchor(word: Column, strongs: Column) -> Column:
    """Where a word leads to: the entry of its first Greek number, else a search."""
    greek = F.get(F.filter(strongs, lambda s: F.startswith(s, F.lit("G"))), F.lit(0))
    number = F.substring(greek, F.lit(2), F.length(greek)).try_cast("long")
    return F.coalesce(F.concat(F.lit("G"), number.cast("string")), F.concat(F.lit("q:"), word))


def listing(blocks: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return blocks.orderBy(order).offset(offset).limit(limit)


def ambiguous_labels(notes: DataFrame, group: list[str]) -> DataFrame:
    """Per group whether its notes' labels do not tell them apart."""
    return notes.groupBy(*group).agg((F.count("label") != F.countDistinct("label")).alias("ambiguous"))


def history(visits: DataFrame, most: int = 100) -> DataFrame:
    """Navigation steps (pane, step, action ``go``/``back``/``forward``, place) folded to each pane's places and cursor.

    Going somewhere cuts off what lay ahead; the oldest place goes when there are more than ``most``.
    """
    shape = "struct<places: array<string>, cursor: int>"
    steps = F.array_sort(F.collect_list(F.struct("step", "action", "place")))

    def step(a: Column, s: Column) -> Column:
        gone = F.concat(F.slice(a["places"], F.lit(1), a["cursor"] + 1), F.array(s["place"]))
        kept = F.when(F.size(gone) > most, F.slice(gone, F.lit(2), F.lit(most))).otherwise(gone)
        same = F.get(a["places"], a["cursor"]).eqNullSafe(s["place"])
        went = F.struct(kept.alias("places"), (F.size(kept) - 1).alias("cursor")).cast(shape)
        moved = lambda by: F.struct(a["places"].alias("places"), F.least(F.greatest(a["cursor"] + by, F.lit(0)), F.size(a["places"]) - 1).alias("cursor")).cast(shape)
        return F.when((s["action"] == "go") & ~same, went).when(s["action"] == "back", moved(-1)).when(s["action"] == "forward", moved(1)).otherwise(a)

    start = F.struct(F.array().cast("array<string>").alias("places"), F.lit(-1).alias("cursor")).cast(shape)
    return visits.groupBy("pane").agg(F.aggregate(steps, start, step).alias("h")).select("pane", "h.places", "h.cursor")


def next_badge(used: Column) -> Column:
    """The first mark that is not in use; null when all are."""
    return F.get(F.array_except(F.array(*[F.lit(b) for b in BADGES]), used), F.lit(0))


def snapped_width(width: Column, column: Column, gutter: Column, available: Column) -> Column:
    """The whole number of columns nearest to a width, as a width; the narrower of two equally near. Unchanged if none fits."""
    most = F.floor((available + gutter) / (column + gutter))
    widths = F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1)).cast("int")), lambda n: n * column + (n - 1) * gutter)
    best = F.array_min(F.transform(widths, lambda w: F.struct(F.abs(w - width).alias("far"), w.alias("w"))))["w"]
    return F.when(column > available, width).otherwise(best)


def fitted_measure(width: Column, size: float, gap_ems: float, measure: float, least: float) -> Column:
    """Columns of the preferred measure in a pane, or none and the measure that one narrow column has."""
    gutter = size * gap_ems
    columns = F.floor((width + gutter) / (size * measure + gutter))
    return F.struct(F.greatest(columns, F.lit(0)).cast("int").alias("columns"), F.when(columns >= 1, F.lit(float(measure))).otherwise(F.least(F.greatest(F.floor(width / size).cast("double"), F.lit(float(least))), F.lit(float(measure)))).alias("measure"))


def hcl(hue: Column, chroma: Column, luminance: Column) -> Column:
    """A colour of CIE LCh(uv), white point D65, as #rrggbb."""
    # The white point, and the matrix of linear sRGB.
    white_u, white_v = 0.1978398, 0.4683363
    matrix = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
    y = F.when(luminance > 8, F.pow((luminance + 16) / 116, 3)).otherwise(luminance / 903.3)
    u = chroma * F.cos(hue * math.pi / 180) / (13 * luminance) + white_u
    v = chroma * F.sin(hue * math.pi / 180) / (13 * luminance) + white_v
    xyz = (y * 9 * u / (4 * v), y, y * (12 - 3 * u - 20 * v) / (4 * v))

    def channel(row: tuple[float, ...]) -> Column:
        t = sum((k * c for k, c in zip(row, xyz, strict=True)), F.lit(0.0))
        gamma = F.when(t <= 0.0031308, 12.92 * t).otherwise(1.055 * F.pow(F.greatest(t, F.lit(0.0)), 1 / 2.4) - 0.055)
        return F.lower(F.lpad(F.hex(F.round(F.least(F.greatest(gamma, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")), 2, "0"))

    return F.when(luminance <= 0, F.lit("#000000")).otherwise(F.concat(F.lit("#"), *[channel(r) for r in matrix]))
