"""A lenient reader of XML and HTML: events in order, whatever the nesting. End tags without a start are reported as they come."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_EVENT = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<(?P<end>/)?(?P<name>[A-Za-z_][\w:.-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|<[!?][^>]*>|(?P<text>[^<]+|<)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_RAW = {"script", "style"}
START, EMPTY, END, TEXT = "start", "empty", "end", "text"


def collapse(text: str) -> str:
    return " ".join(text.split())


def attributes(rest: str) -> dict[str, str]:
    return {m[1]: html.unescape(m[2] if m[2] is not None else m[3]) for m in _ATTRIBUTE.finditer(rest)}


def events(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, local name or text, attributes)."""
    at = 0
    while m := _EVENT.match(text, at):
        at = m.end()
        if m["text"]:
            yield TEXT, html.unescape(m["text"]), {}
        elif m["cdata"] is not None:
            yield TEXT, m["cdata"], {}
        elif m["name"]:
            name = m["name"].rpartition(":")[2]
            if m["end"]:
                yield END, name, {}
            elif m["rest"].endswith("/"):
                yield EMPTY, name, attributes(m["rest"])
            else:
                yield START, name, attributes(m["rest"])
                if name.lower() in _RAW:
                    close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(text, at)
                    at = close.end() if close else len(text)
                    yield END, name, {}
