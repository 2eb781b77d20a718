"""Documents as block rows: HTML pages, EPUB books and ODT texts."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_files
from .markup import EMPTY, END, START, TEXT, collapse, events

SCHEMA = "pos int, kind string, level int, text string"
_HEADS = {f"h{i}": i for i in range(1, 7)}
_LEAVES = {"p": "paragraph", "li": "item", "td": "cell", "th": "cell", "figcaption": "caption", "blockquote": "quote", "pre": "paragraph", "div": "paragraph", "article": "paragraph", "section": "paragraph", "body": "paragraph"}
_HIDDEN = {"script", "style", "head", "nav", "template"}


def html_blocks(page: str) -> Iterator[dict]:
    """Headings, paragraphs, items, cells, rules and figures in reading order. Navigation and hidden parts are left out."""
    open_kinds: list[tuple[str, str, int]] = []
    text, hidden, pos = "", 0, 0

    def flush() -> Iterator[dict]:
        nonlocal text, pos
        whole, text = collapse(text), ""
        if whole:
            _, kind, level = open_kinds[-1] if open_kinds else ("", "paragraph", 0)
            yield {"pos": pos, "kind": kind, "level": level, "text": whole}
            pos += 1

    for what, name, a in events(page):
        tag = name.lower()
        if what == TEXT:
            text += "" if hidden else name
        elif tag in _HIDDEN and what in (START, END):
            hidden = max(0, hidden + (1 if what == START else -1))
        elif hidden:
            continue
        elif what in (START, EMPTY) and tag in ("br", "hr", "img"):
            if tag == "br":
                text += " "
            else:
                yield from flush()
                yield {"pos": pos, "kind": "rule" if tag == "hr" else "figure", "level": 0, "text": a.get("alt", "")}
                pos += 1
        elif tag in _HEADS or tag in _LEAVES:
            yield from flush()
            if what == START:
                open_kinds.append((tag, "heading" if tag in _HEADS else _LEAVES[tag], _HEADS.get(tag, 0)))
            elif what == END:
                for i in range(len(open_kinds) - 1, -1, -1):
                    if open_kinds[i][0] == tag:
                        del open_kinds[i:]
                        break
    yield from flush()


def _renumbered(parts: Iterable[Iterable[dict]]) -> Iterator[dict]:
    pos = 0
    for part in parts:
        for row in part:
            yield row | {"pos": pos}
            pos += 1


def epub(content: bytes) -> Iterator[dict]:
    """The spine's documents in order; encrypted books are refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "META-INF/encryption.xml" in names and any(n == "EncryptedData" for k, n, _ in events(z.read("META-INF/encryption.xml").decode()) if k == START):
            raise ValueError("encrypted")
        root = next(a["full-path"] for k, n, a in events(z.read("META-INF/container.xml").decode()) if n == "rootfile" and k in (START, EMPTY))
        items, spine = {}, []
        for k, n, a in events(z.read(root).decode()):
            if k in (START, EMPTY) and n == "item":
                items[a["id"]] = posixpath.normpath(posixpath.join(posixpath.dirname(root), a["href"]))
            elif k in (START, EMPTY) and n == "itemref":
                spine.append(a["idref"])
        yield from _renumbered(html_blocks(z.read(items[i]).decode()) for i in spine if items.get(i) in names)


def odt(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = z.read("content.xml").decode()
    text, kind, level, depth, pos, notes = "", "", 0, 0, 0, 0
    for what, name, a in events(body):
        if what == TEXT:
            text += name if kind and not notes else ""
        elif name == "note" and what in (START, END):
            notes += 1 if what == START else -1
        elif name == "list" and what in (START, END):
            depth += 1 if what == START else -1
        elif what == EMPTY and name in ("s", "tab", "line-break"):
            text += " " * int(a.get("text:c", 1)) if name == "s" else " "
        elif what == START and name in ("p", "h") and not notes:
            text, kind = "", "heading" if name == "h" else "item" if depth else "paragraph"
            level = int(a.get("text:outline-level", 1)) if name == "h" else 0
        elif what == END and name in ("p", "h") and not notes:
            if collapse(text):
                yield {"pos": pos, "kind": kind, "level": level, "text": collapse(text)}
                pos += 1
            kind = ""


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return read_files(spark, path, {"epub": epub, "odt": odt, "html": lambda c: html_blocks(c.decode())}[kind], SCHEMA)


def pages(rows: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Blocks of HTML held in a column."""
    from ..session import importable

    importable(rows.sparkSession)

    @F.pandas_udf(f"array<struct<{SCHEMA.replace(' int', ': int').replace(' string', ': string')}>>")
    def run(texts):
        import pandas as pd

        return pd.Series([list(html_blocks(t or "")) for t in texts])

    return rows.select(key, F.explode(run(html)).alias("b")).select(key, "b.*")


def sections(blocks: DataFrame, key: str) -> DataFrame:
    """A section at every heading: ordinal, level, name and the text below it."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("pos")
    at = blocks.withColumn("ordinal", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(w))
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") != "heading", F.struct("pos", "text"))))
    return at.groupBy(key, "ordinal").agg(F.max(F.when(F.col("kind") == "heading", F.col("level"))).alias("level"), F.max(F.when(F.col("kind") == "heading", F.col("text"))).alias("name"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def title_of(page: str) -> str:
    m = re.search(r"<title[^>]*>(.*?)</title>", page, re.DOTALL | re.IGNORECASE)
    return collapse(m[1]) if m else ""
