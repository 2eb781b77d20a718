"""Rules on single texts of imported documents, as column expressions; those on bytes and style sheets as Arrow UDFs."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BOOKS

_SPACE = r"[  ]"
#: A paragraph's list mark: a number of up to two digits, a bullet, or a letter, each with its space.
LIST_MARK = rf"^\s*(?:[0-9]{{1,2}}(?:[.)]{_SPACE}|\.\t)(?=.)|(?:[•–\-·▪■◦] |[•–] )(?=.)|[a-z][.)]{_SPACE})"
# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Tags that begin a block of text.
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ol", "ul", "li", "table", "tr", "td", "th", "blockquote", "section", "aside", "figure", "pre")
# File endings of images and their media types.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml"}
STYLES = ("bold", "italic", "small_caps", "superscript", "subscript", "monospace", "hidden")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def list_mark(text: Column) -> Column:
    """The list mark that a paragraph begins with, white space before it included; null without one."""
    return _found(text, rf"(?s)({LIST_MARK})")


def list_number(text: Column) -> Column:
    return F.when(list_mark(text).isNotNull(), _found(text, r"^\s*([0-9]{1,2})").cast("int"))


def without_list_mark(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?s){LIST_MARK}", "")


def leading_number(text: Column, mark: str = " ") -> Column:
    """A number of up to three digits that opens a text and is followed by ``mark``."""
    return _found(text, rf"^\s*([0-9]{{1,3}}){re.escape(mark)}").cast("int")


def verse_lead(text: Column) -> Column:
    """The verse that a paragraph says it treats: ``V. 6``, ``V.6a``, ``Vers 6``."""
    return _found(text, r"^\s*(?:V\.|Verse? )\s*([0-9]{1,3})(?![0-9])(?:[ab]|(?![\p{L}\p{N}]))").cast("int")


def bold_number(text: Column, bold: Column) -> Column:
    """The verse of a bold run that is just a number, up to the longest chapter's 176."""
    n = _found(text, r"^\s*([0-9]{1,3})\.*\s*$").cast("int")
    return F.when(bold & n.between(1, 176), n)


def locator(text: Column) -> Column:
    """``(2,7) rest`` as chapter, verse and rest; null for other texts."""
    shape = r"(?s)^\s*\(\s*([0-9]{1,5})\s*,\s*([0-9]{1,5})\s*\)\s*(.*?)\s*$"
    part = lambda i: F.regexp_extract(text, shape, i)
    return F.when(text.rlike(shape), F.struct(part(1).cast("int").alias("chapter"), part(2).cast("int").alias("verse"), part(3).alias("rest")))


def mark_label(run: Column) -> Column:
    """The label of a raised run: digits or one letter, with nothing but stops after it; else empty."""
    return F.regexp_extract(F.trim(run), r"^([0-9]+|[a-z])[,.;:)]*$", 1)


def note_label(text: Column) -> Column:
    """The label that opens a note: a letter and a space, or up to three digits and a space or a dot and a space."""
    return _found(text, rf"^(?:([a-z])(?= )|([0-9]{{1,3}})(?=\.?{_SPACE}))", 0)


def without_note_label(text: Column) -> Column:
    """A note's text after ``[label]`` or a number with its stops, as label and rest."""
    inner = F.regexp_extract(text, r"^\[([^\]]{0,3})\]", 1)
    rest = F.regexp_replace(text, r"^\[[^\]]{0,3}\]\s*", "")
    shape = rf"^([0-9]{{1,3}})(?:[.)]|{_SPACE})+"
    label = F.coalesce(F.nullif(F.trim(inner), F.lit("")), _found(rest, shape), F.lit(""))
    return F.struct(label.alias("label"), F.regexp_replace(rest, shape, "").alias("rest"))


def hyphen_joined(line: Column, following: Column) -> Column:
    """Two lines as one text: a soft hyphen at the end always goes, a hard one before a small letter; else a space joins them."""
    soft, hard = r"­\s*$", r"(?<=.)-\s*$"
    small = following.rlike(r"^\p{Ll}")
    return F.when(line.rlike(soft), F.concat(F.regexp_replace(line, soft, ""), following)).when(line.rlike(hard) & small, F.concat(F.regexp_replace(line, rf" *{hard}", ""), following)).otherwise(F.concat_ws(" ", F.rtrim(line), following))


def without_ligatures(text: Column) -> Column:
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def decoded(content: Column, code_page: str) -> Column:
    """Bytes of a one-byte code page (``mac_roman``, ``cp1252``) as text."""

    @F.pandas_udf("string")
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda b: None if b is None else bytes(b).decode(code_page, "replace"))

    return run(content)


def percent_decoded(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda t: None if t is None else unquote_to_bytes(t).decode("utf-8", "replace"))

    return F.when(F.contains(text, F.lit("%")), run(text)).otherwise(text)


def joined_path(folder: Column, href: Column) -> Column:
    """A link against a folder: without its fragment, ``.`` dropped and ``..`` going up."""
    parts = F.concat(F.split(folder, "/"), F.split(percent_decoded(F.substring_index(href, "#", 1)), "/"))
    step = lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def chapter_of_file(path: Column) -> Column:
    """``Esth-4.xhtml`` names a book and chapter: ``Esth.4``."""
    stem = F.substring_index(F.substring_index(path, "/", -1), ".", 1)
    book, chapter = F.substring_index(stem, "-", 1), _found(stem, "^[^-]+-([0-9]{1,5})$").cast("int")
    return F.when(book.isin(*BOOKS) & chapter.isNotNull(), F.concat_ws(".", book, chapter.cast("string")))


def is_block_tag(name: Column) -> Column:
    return name.isin(*BLOCK_TAGS)


def is_verse_class(classes: Column) -> Column:
    return classes.rlike(r"(?:^|\s)(?:vers\S*|vn|v|\S*(?:verse-num|versenum)\S*)(?:\s|$)")


def poetry_indent(classes: Column) -> Column:
    """The indent of a line of poetry, by its classes in order."""
    name = _found(classes, r"(?:^|\s)(poline\S*|q|q1|q2|poetry)(?=\s|$)")
    return F.when(F.startswith(name, F.lit("poline")), F.coalesce(_found(name, r"^poline([0-9]{1,3})$").cast("int"), F.lit(1))).when(name == "q2", 2).when(name.isNotNull(), 1)


def media_type(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ending, kind in MEDIA_TYPES.items():
        out = F.when(F.endswith(F.lower(path), F.lit(f".{ending}")), F.lit(kind)).otherwise(out)
    return out


def class_styles(css: str) -> dict[str, set[str]]:
    """What plain class selectors of a style sheet say of the reading voice."""
    tests = {
        "font-style": (("italic", r"italic|oblique"),), "font-weight": (("bold", r"bold|[6-9][0-9]{2}$|[1-9][0-9]{3,}$"),), "font-variant": (("small_caps", r".*small-caps"),),
        "vertical-align": (("superscript", r".*(?:super|text-top)"), ("subscript", r"(?!.*(?:super|text-top)).*sub")), "font-family": (("monospace", r".*(?:mono|courier)"),), "display": (("hidden", r"none$"),),
    }
    found: dict[str, set[str]] = {}
    for selectors, body in re.findall(r"([^{}]*)\{([^{}]*)", re.sub(r"/\*.*?\*/", "", css, flags=re.DOTALL)):
        pairs = [(k.strip().lower(), v.strip().lower()) for k, _, v in (d.partition(":") for d in body.split(";"))]
        styles = {style for k, v in pairs for style, shape in tests.get(k, ()) if re.match(shape, v)}
        for selector in selectors.split(","):
            if styles and (m := re.fullmatch(r"[^\s:>]*\.([^\s:>.]+)", selector.strip())):
                found.setdefault(m[1], set()).update(styles)
    return found


def class_styles_udf():
    @F.pandas_udf("map<string, array<string>>")
    def run(sheets: pd.Series) -> pd.Series:
        return sheets.map(lambda css: {k: [s for s in STYLES if s in v] for k, v in class_styles(css or "").items()})

    return run


#: Marks of JPEG segments: those that hold the frame's measures, and those that stand alone.
FRAMES, BARE = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}, {0x01, *range(0xD0, 0xD9)}
_MARK = re.compile(rb"\xff+([^\x00\xff])")


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Mark and content of each segment; bytes between segments are passed over."""
    found = _MARK.search(data)
    while found:
        size = 0 if found[1][0] in BARE else int.from_bytes(data[found.end() : found.end() + 2])
        yield found[1][0], data[found.end() + 2 : found.end() + size]
        found = _MARK.search(data, found.end() + size)


def picture_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG's first chunk, or from the first frame of a JPEG."""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    frames = (content for mark, content in jpeg_segments(data) if mark in FRAMES and len(content) >= 5) if data.startswith(b"\xff\xd8") else iter(())
    return next((struct.unpack(">HH", content[1:5])[::-1] for content in frames), None)


def picture_size_udf():
    @F.pandas_udf("struct<width: int, height: int>")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([picture_size(bytes(c or b"")) or (None, None) for c in contents], columns=["width", "height"]).astype("Int32")

    return run


def word_offsets(text: Column) -> Column:
    """Words between white space, each with the byte at which it begins."""
    parts = F.regexp_extract_all(text, F.lit(r"(?U)(\s*)(\S*)"), F.lit(0))
    shift = lambda a, p: F.struct((a["at"] + F.octet_length(p)).alias("at"), F.when(p.rlike(r"(?U)\S"), F.concat(a["out"], F.array(F.struct(F.regexp_extract(p, r"(?U)\s*(\S*)", 1).alias("word"), (a["at"] + F.octet_length(F.regexp_extract(p, r"(?U)(\s*)", 1))).alias("start"))))).otherwise(a["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word: string, start: int>>").alias("out"))
    return F.aggregate(parts, start, shift, lambda a: a["out"])


def small_caps(text: Column, set_so: Column) -> Column:
    return F.when(set_so, F.upper(text)).otherwise(text)
