"""Packaged text modules: a zip with a configuration and one binary driver's files.

Drivers: verse-addressed compressed texts (commentaries and Bibles), compressed lexica (dictionaries and devotionals)
and raw general books. All numbers are little-endian.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..schema import BOOKS
from .files import read_files
from .markup import EMPTY, END, START, TEXT, collapse, events
from .osis import verse_id

SCHEMA = "kind string, code string, title string, language string, pos int, key string, book int, chapter int, verse int, verse_end int, seq int, start int, ref_end int, level int, head string, pron string, strong string, text string, paragraph boolean"


def configuration(text: str) -> dict[str, str]:
    """The section's name as ``code``, and keys to values; the first of a key counts, ``Feature`` values are joined."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        if m := re.fullmatch(r"\s*\[(.+)\]\s*", line):
            out.setdefault("code", m[1])
        elif "=" in line:
            k, _, v = line.partition("=")
            if k.strip() == "Feature":
                out["Feature"] = " ".join(filter(None, (out.get("Feature"), v.strip())))
            else:
                out.setdefault(k.strip(), v.strip())
    return out


def _block(bzs: bytes, bzz: bytes, n: int) -> bytes:
    at, size, _ = struct.unpack_from("<3I", bzs, 12 * n)
    return zlib.decompress(bzz[at : at + size])


def _slots(bzs: bytes, bzv: bytes, bzz: bytes) -> Iterator[tuple[int, str]]:
    """(slot, fragment) of slots that hold bytes."""
    blocks: dict[int, bytes] = {}
    for i, (block, at, size) in enumerate(struct.iter_unpack("<IIH", bzv)):
        if size:
            if block not in blocks:
                blocks = {block: _block(bzs, bzz, block)}
            yield i, blocks[block][at : at + size].decode("utf-8")


def commentary(files: dict[str, bytes]) -> Iterator[dict]:
    """Entries with the verses they are for; linked slots carry one entry once."""
    seen: set[str] = set()
    for t in ("ot", "nt"):
        if f"{t}.bzs" not in files:
            continue
        for _, fragment in _slots(*(files[f"{t}.{x}"] for x in ("bzs", "bzv", "bzz"))):
            if fragment in seen:
                continue
            seen.add(fragment)
            at, head, parts, text, in_head = None, "", [], "", False
            for kind, name, a in events(fragment):
                if kind == TEXT:
                    head, text = (head + name, text) if in_head else (head, text + name)
                elif "annotateRef" in a and "sID" in a:
                    first, _, last = a["annotateRef"].partition("-")
                    at = (verse_id(first), verse_id(last or first))
                elif name == "title":
                    in_head = kind == START
                elif name == "div" and a.get("type") == "x-p":
                    parts, text = [*parts, collapse(text)], ""
            body = "\n\n".join(filter(None, [*parts, collapse(text)]))
            if at and at[0] and at[1] and body:
                yield {"kind": "comment", "book": at[0][0], "chapter": at[0][1], "verse": at[0][2], "verse_end": at[1][2], "head": collapse(head) or None, "text": body}


def bible(files: dict[str, bytes]) -> Iterator[dict]:
    """Verses and the word links inside them, by byte range of the collapsed text.

    Structural slots name the book and chapter that follow; a slot with text is the next verse of its chapter.
    """
    for t in ("ot", "nt"):
        if f"{t}.bzs" not in files:
            continue
        book, chapter, verse, last = None, 0, 0, -1
        for slot, fragment in _slots(*(files[f"{t}.{x}"] for x in ("bzs", "bzv", "bzz"))):
            place = re.findall(r"<(?:chapter|div)[^>]*osisID=\"(\w+)(?:\.(\d+))?\"", fragment)
            if place:
                book = BOOKS.index(place[-1][0]) if place[-1][0] in BOOKS else None
                chapter, verse, last = int(place[-1][1] or 0), 0, slot
            text, links, open_at, strongs, hidden, opens = "", [], 0, [], 0, False
            for kind, name, a in events(fragment):
                if kind == TEXT and not hidden:
                    joined = re.sub(r"\s+", " ", name)
                    text += joined.lstrip() if not text or text.endswith(" ") else joined
                elif name in ("note", "title") and kind in (START, END):
                    hidden += 1 if kind == START else -1
                elif name == "w" and kind == START:
                    open_at, strongs = len(text.encode()), re.findall(r"strong:([GH]\d+)", a.get("lemma", ""))
                elif name == "w" and kind == END:
                    links += [(open_at, len(text.encode()), s) for s in strongs]
                elif kind == EMPTY and (name == "milestone" and a.get("type") == "x-p" or name in ("p", "div") and a.get("type") == "x-p"):
                    opens |= not text.strip()
            verse += slot - last
            last = slot
            if book is None or not text.strip() or place and not chapter:
                continue
            where = {"book": book, "chapter": chapter, "verse": verse}
            yield {"kind": "verse", **where, "text": text.strip(), "paragraph": opens}
            for i, (a, b, s) in enumerate(links):
                yield {"kind": "link", **where, "seq": i + 1, "start": a, "ref_end": b, "strong": s}


def lexicon(files: dict[str, bytes], devotional: bool) -> Iterator[dict]:
    """Entries in key order with headword, pronunciation and text."""
    idx, dat, zdx, zdt = (files[f"dict.{x}"] for x in ("idx", "dat", "zdx", "zdt"))
    blocks: dict[int, bytes] = {}
    rows = []
    for at, _ in struct.iter_unpack("<II", idx):
        end = dat.index(b"\r\n", at)
        key = dat[at:end].decode("utf-8")
        block, entry = struct.unpack_from("<II", dat, end + 2)
        if block not in blocks:
            place, size = struct.unpack_from("<II", zdx, 8 * block)
            blocks[block] = zlib.decompress(zdt[place : place + size])
        body, size = struct.unpack_from("<II", blocks[block], 4 + 8 * entry)
        fragment = blocks[block][body : body + size].rstrip(b"\0").decode("utf-8")
        text = {"orth": "", "pron": "", "": ""}
        into = ""
        for kind, name, _a in events(fragment):
            if kind == TEXT:
                text[into] += name.replace("\n", " ")
            elif name in ("orth", "pron"):
                into = name if kind == START else ""
            elif name == "lb":
                text[into] += "\n"
        lines = [collapse(x) for x in text[""].split("\n")]
        if devotional:
            month, day = (int(x) for x in re.findall(r"\d+", key)[:2])
            sort = (month * 100 + day) * 10
        else:
            sort = int(re.sub(r"\D", "", key) or 0)
        rows.append((sort, {"kind": "entry", "key": key, "head": collapse(text["orth"]) or key, "pron": collapse(text["pron"]), "text": "\n".join(filter(None, lines))}))
    for sort, row in sorted(rows, key=lambda r: r[0]):
        yield row | {"seq": sort}


def general_book(files: dict[str, bytes]) -> Iterator[dict]:
    """Sections depth first from the tree of parent, next and first child."""
    idx, dat, bdt = (files[x] for x in ("book.idx", "book.dat", "book.bdt"))
    todo, order = [(0, 0)], 0
    while todo:
        node, level = todo.pop()
        at = struct.unpack_from("<I", idx, node)[0]
        _, following, child = struct.unpack_from("<3I", dat, at)
        end = dat.index(b"\0", at + 12)
        name, size = dat[at + 12 : end].decode("utf-8"), struct.unpack_from("<H", dat, end + 1)[0]
        if following != 0xFFFFFFFF:
            todo.append((following, level))
        if child != 0xFFFFFFFF:
            todo.append((child, level + 1))
        if level:
            place, length = struct.unpack_from("<II", dat, end + 3) if size >= 8 else (0, 0)
            body = bdt[place : place + length].decode("utf-8")
            yield {"kind": "section", "seq": order, "level": level, "head": name, "text": collapse("".join(n for k, n, _ in events(body) if k == TEXT))}
            order += 1


def parse(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        files = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
    conf = configuration(next(v for k, v in files.items() if k.endswith(".conf")).decode("utf-8"))
    short = {k.rsplit("/", 1)[-1]: v for k, v in files.items()}
    driver = conf.get("ModDrv", "")
    by_suffix = lambda stem: {f"{stem}.{k.rsplit('.', 1)[-1]}": v for k, v in short.items() if not k.endswith(".conf")}
    if conf.get("CipherKey"):
        raise ValueError("locked module")
    if driver.startswith("zCom"):
        rows = commentary(short)
    elif driver.startswith("zText"):
        rows = bible(short)
    elif driver.startswith("zLD"):
        rows = lexicon(by_suffix("dict"), "DailyDevotion" in conf.get("Feature", "") or "Devotional" in conf.get("Category", ""))
    elif driver.startswith("RawGenBook"):
        rows = general_book(by_suffix("book"))
    else:
        raise ValueError(f"driver {driver or 'missing'}")
    meta = {"code": conf["code"], "title": conf.get("Description", conf["code"]), "language": conf.get("Lang", "")}
    for pos, row in enumerate(rows):
        yield row | meta | {"pos": pos}


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, parse, SCHEMA)
