"""OSIS Bibles, container and milestone form: verses, headings and notes as tagged rows, and a writer.

Reading has two steps. ``spans`` flattens the markup: every piece of text gets a role from the elements around it, and
every boundary becomes a mark. ``rows`` cuts the spans at verse boundaries and derives each verse's text, notes, headings and
paragraph flag from the order of its spans and of those in the gap before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import xml_escape
from ..schema import BOOKS
from .files import read_files
from .markup import EMPTY, END, START, TEXT, collapse, events

SCHEMA = "kind string, code string, language string, title string, pos int, book int, chapter int, verse int, seq int, level int, offset int, text string, paragraph boolean"
_PLACE = {osis: i for i, osis in enumerate(BOOKS)}
_PARAGRAPHS = {"p", "lg", "l"}
_LEVELS = {"section": 1, "subSection": 2}
#: Roles of text: of the work's title, of a heading, of a note, of what is left out, of verses.
WORK, HEADING, NOTE, OUT, BODY = "work", "heading", "note", "out", "body"
#: Roles of marks: a verse begins or ends, a paragraph begins, a section of some level begins.
VERSE, CLOSE, PARAGRAPH, SECTION, ROOT = "verse", "close", "paragraph", "section", "root"


@dataclass(frozen=True)
class Span:
    role: str
    value: object
    #: Tells apart neighbours of one role that belong to different elements.
    owner: int = 0


def verse_id(osis_id: str) -> tuple[int, int, int] | None:
    """The first id of a list, without its part after ``!``; None outside the canon."""
    parts = (osis_id.split() or [""])[0].partition("!")[0].split(".")
    if len(parts) < 3 or parts[0] not in _PLACE or not (parts[1].isdigit() and parts[2].isdigit()):
        return None
    return _PLACE[parts[0]], int(parts[1]), int(parts[2])


def _role(name: str, a: dict[str, str], around: str) -> str:
    """The role of text in an element, by the role around it."""
    if around in (NOTE, OUT) or name in ("note", "header"):
        return NOTE if name == "note" and around != OUT else OUT if name == "header" else around
    if name == "title":
        return OUT if "type" in a or around == OUT else HEADING
    return around


def spans(content: bytes) -> Iterator[Span]:
    """All spans of a document in order."""
    around: list[tuple[str, str, int]] = [("", BODY, 0)]
    for n, (kind, name, a) in enumerate(events(content.decode("utf-8"))):
        role, owner = around[-1][1:]
        quiet = role in (NOTE, OUT)
        if kind == TEXT:
            if role != OUT:
                yield Span(role, name, owner)
            continue
        if kind == END:
            depth = next((i for i in range(len(around) - 1, 0, -1) if around[i][0] == name), 0)
            if depth:
                del around[depth:]
            if name == "verse":
                yield Span(CLOSE, None)
            continue
        if name == "osisText":
            yield Span(ROOT, a)
        elif name == "verse" and ("sID" in a and kind == EMPTY or "osisID" in a):
            yield Span(VERSE, verse_id(a.get("sID") if kind == EMPTY and "sID" in a else a["osisID"]))
        elif name == "verse" and "eID" in a:
            yield Span(CLOSE, None)
        elif name == "div" and a.get("type") in _LEVELS:
            yield Span(SECTION, _LEVELS[a["type"]])
        elif name == "lb" and not quiet:
            yield Span(role, " ", owner)
        elif not quiet and (name in _PARAGRAPHS and (kind == START or "sID" in a) or name == "milestone" and a.get("type") == "x-p"):
            yield Span(PARAGRAPH, None)
        if kind == START:
            own = WORK if name == "title" and any(x[0] == "header" for x in around) else _role(name, a, role)
            around.append((name, own, n if own != role else owner))


def _headings(own: list[Span], level: int) -> tuple[list[tuple[int, str]], int]:
    """(level, text) of headings, and the level that the next one has. A section's level holds for one heading."""
    out, ends = [], {s.owner: i for i, s in enumerate(own) if s.role == HEADING}
    parts: dict[int, list[str]] = {}
    for i, s in enumerate(own):
        if s.role == SECTION:
            level = s.value
        elif s.role == HEADING:
            parts.setdefault(s.owner, []).append(s.value)
            if i == ends[s.owner]:
                if text := collapse("".join(parts[s.owner])):
                    out.append((level, text))
                    level = 1
                parts.clear()
    return out, level


def _notes(own: list[Span]) -> list[tuple[int, str]]:
    """Notes with the bytes of text before them, spaces collapsed, in one pass."""
    size, space, found = 0, False, {}
    for s in own:
        if s.role == NOTE:
            found.setdefault(s.owner, (size, []))[1].append(s.value)
        elif s.role == BODY:
            for word in re.findall(r"\s+|\S+", s.value):
                if word.isspace():
                    space = size > 0
                else:
                    size, space = size + space + len(word.encode()), False
    texts = ((at, collapse("".join(parts))) for at, parts in found.values())
    return [(at, text) for at, text in texts if text]


def rows(all_spans: list[Span]) -> Iterator[dict]:
    """Rows of verses, headings and notes, in order."""
    bounds = [i for i, s in enumerate(all_spans) if s.role in (VERSE, CLOSE)]
    waiting, level, flag, seq, pos = [], 1, False, {}, 0
    for begin, end in zip([-1, *bounds], [*bounds, len(all_spans)], strict=True):
        mark = all_spans[begin] if begin >= 0 else Span(CLOSE, None)
        own = all_spans[begin + 1 : end]
        found, level = _headings(own, level)
        waiting += found
        place = mark.value if mark.role == VERSE else None
        if mark.role == VERSE:
            opens, flag = flag, False
        if place is None:
            # A gap: its headings and its paragraph wait for the next verse.
            flag = flag or any(s.role == PARAGRAPH for s in own)
            continue
        first = next((i for i, s in enumerate(own) if s.role == BODY and s.value.strip()), len(own))
        opens = opens or any(s.role == PARAGRAPH for s in own[:first])
        made = [{"kind": "heading", "level": n, "text": t} for n, t in waiting]
        waiting = []
        made += [{"kind": "note", "offset": at, "text": text} for at, text in _notes(own)]
        text = collapse("".join(s.value for s in own if s.role == BODY))
        if text:
            made.append({"kind": "verse", "text": text, "paragraph": opens})
        for row in made:
            if row["kind"] != "verse":
                key = row["kind"], place
                seq[key] = row["seq"] = seq.get(key, 0) + 1
            yield {"pos": pos, **dict(zip(("book", "chapter", "verse"), place, strict=True)), **row}
            pos += 1


def parse(content: bytes) -> Iterator[dict]:
    found = list(spans(content))
    out = list(rows(found))
    if not any(r["kind"] == "verse" for r in out):
        raise ValueError("no verses")
    root = next((s.value for s in found if s.role == ROOT), {})
    if not root.get("osisIDWork"):
        raise ValueError("no work id")
    titles = (collapse("".join(s.value for s in group)) for _, group in groupby((s for s in found if s.role == WORK), lambda s: s.owner))
    title = next(filter(None, titles), "")
    for row in out:
        yield row | {"code": root["osisIDWork"], "language": root.get("xml:lang", ""), "title": title}


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, parse, SCHEMA)


def documents(verses: DataFrame, notes: DataFrame | None = None, headings: DataFrame | None = None) -> DataFrame:
    """code, xml of whole documents from verses (code, language, title, book, chapter, verse, text, paragraph).

    Notes (code, book, chapter, verse, seq, offset, text) are put in at their byte offset, or at the last character bound
    before it; headings (code, book, chapter, verse, seq, level, text) stand before their verse, by seq.
    """
    osis = F.element_at(F.array(*[F.lit(b) for b in BOOKS]), F.col("book") + 1)
    rows = verses
    key = ["code", "book", "chapter", "verse"]
    body: Column = xml_escape(F.col("text"))
    if notes is not None:
        own = notes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("offset", "seq", F.col("text").alias("note")))).alias("_notes"))
        rows = rows.join(own, key, "left")
        part = lambda a, b: xml_escape(F.decode(F.substring(F.encode("text", "UTF-8"), a + 1, b - a), "UTF-8"))
        size = F.octet_length("text")
        whole_to = lambda o: F.is_valid_utf8(F.substring(F.encode("text", "UTF-8"), F.lit(1), o).cast("string"))
        bound = lambda o: F.coalesce(*[F.when(whole_to(o - i), o - i) for i in range(4)], F.lit(0))
        ends = F.concat(F.transform("_notes", lambda n: bound(F.greatest(F.lit(0), F.least(n["offset"], size)))), F.array(size))
        pieces = F.transform(ends, lambda e, i: part(F.when(i > 0, F.get(ends, i - 1)).otherwise(0), e))
        marked = F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.concat(F.lit("<note>"), xml_escape(F.get("_notes", i)["note"]), F.lit("</note>")), F.lit(""))))
        body = F.when(F.col("_notes").isNull(), body).otherwise(F.array_join(marked, ""))
    before = F.lit("")
    if headings is not None:
        own = headings.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "level", F.col("text").alias("heading")))).alias("_headings"))
        rows = rows.join(own, key, "left")
        titled = lambda h: F.concat(F.when(h["level"] > 1, F.lit('<div type="subSection"/>')).otherwise(F.lit("")), F.lit("<title>"), xml_escape(h["heading"]), F.lit("</title>"))
        before = F.coalesce(F.array_join(F.transform("_headings", titled), ""), F.lit(""))
    place = F.concat_ws(".", osis, F.col("chapter").cast("string"), F.col("verse").cast("string"))
    verse = F.concat(before, F.when(F.col("paragraph"), F.lit('<milestone type="x-p"/>')).otherwise(F.lit("")), F.lit('<verse osisID="'), place, F.lit('">'), body, F.lit("</verse>"))
    chapters = rows.groupBy("code", "language", "title", "book", "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verse", verse.alias("x")))), lambda v: v["x"]), "").alias("x"))
    whole = chapters.groupBy("code", "language", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("book", "chapter", "x"))), lambda c: F.concat(F.lit("<chapter>"), c["x"], F.lit("</chapter>"))), "").alias("x"))
    head = F.concat(F.lit('<osis><osisText osisIDWork="'), xml_escape(F.col("code")), F.lit('" xml:lang="'), xml_escape(F.col("language")), F.lit('"><header><work><title>'), xml_escape(F.col("title")), F.lit("</title></work></header>"))
    return whole.select("code", F.concat(head, F.col("x"), F.lit("</osisText></osis>")).alias("xml"))
