"""Passage references: strict parsing and scanning of prose, by one compiled pattern and a fold over its matches.

Names are a parameter; the built-in tables know OSIS ids, English, German and short forms. What a bare pair of numbers means
depends on the reference before it, so a scan is sequential inside a text and runs as an Arrow UDF over texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BOOKS

# Fixed values, a row a book in canon order: OSIS id, English and German name, short form, further abbreviations.
NAMES = """
Gen | Genesis | 1. Mose | 1Mo | 1mo 1mos
Exod | Exodus | 2. Mose | 2Mo | 2mo 2mos ex
Lev | Leviticus | 3. Mose | 3Mo | 3mo 3mos levitikus
Num | Numbers | 4. Mose | 4Mo | 4mo 4mos numeri
Deut | Deuteronomy | 5. Mose | 5Mo | 5mo 5mos dtn dt deuteronomium
Josh | Joshua | Josua | Jos | jos
Judg | Judges | Richter | Ri | ri
Ruth | Ruth | Rut | Rut |
1Sam | 1 Samuel | 1. Samuel | 1Sa | 1sa 1sm
2Sam | 2 Samuel | 2. Samuel | 2Sa | 2sa 2sm
1Kgs | 1 Kings | 1. Könige | 1Kö | 1koen 1kg 1ki
2Kgs | 2 Kings | 2. Könige | 2Kö | 2koen 2kg 2ki
1Chr | 1 Chronicles | 1. Chronik | 1Ch | 1ch 1chronika
2Chr | 2 Chronicles | 2. Chronik | 2Ch | 2ch 2chronika
Ezra | Ezra | Esra | Esr | esr
Neh | Nehemiah | Nehemia | Neh |
Esth | Esther | Ester | Est | est
Job | Job | Hiob | Hi | hi
Ps | Psalms | Psalmen | Ps | psalm pss
Prov | Proverbs | Sprüche | Spr | spr prv
Eccl | Ecclesiastes | Prediger | Pred | pred koh kohelet ecc qoh
Song | Song of Solomon | Hoheslied | Hld | hld hohelied sos
Isa | Isaiah | Jesaja | Jes | jes
Jer | Jeremiah | Jeremia | Jer |
Lam | Lamentations | Klagelieder | Klgl | klgl kla
Ezek | Ezekiel | Hesekiel | Hes | hes ez ezechiel
Dan | Daniel | Daniel | Dan | dn
Hos | Hosea | Hosea | Hos |
Joel | Joel | Joel | Joel | jl
Amos | Amos | Amos | Am | am
Obad | Obadiah | Obadja | Ob | obd ob
Jonah | Jonah | Jona | Jona | jon
Mic | Micah | Micha | Mi | mi
Nah | Nahum | Nahum | Nah | nam
Hab | Habakkuk | Habakuk | Hab |
Zeph | Zephaniah | Zefanja | Zef | zef zep zephanja
Hag | Haggai | Haggai | Hag | hgg
Zech | Zechariah | Sacharja | Sach | sach zec
Mal | Malachi | Maleachi | Mal |
Matt | Matthew | Matthäus | Mt | mt mat
Mark | Mark | Markus | Mk | mk mrk
Luke | Luke | Lukas | Lk | lk luk
John | John | Johannes | Joh | joh jn
Acts | Acts | Apostelgeschichte | Apg | apg act
Rom | Romans | Römer | Rö | rm roem
1Cor | 1 Corinthians | 1. Korinther | 1Ko | 1kor 1co
2Cor | 2 Corinthians | 2. Korinther | 2Ko | 2kor 2co
Gal | Galatians | Galater | Gal |
Eph | Ephesians | Epheser | Eph |
Phil | Philippians | Philipper | Phil | php
Col | Colossians | Kolosser | Kol | kol
1Thess | 1 Thessalonians | 1. Thessalonicher | 1Th | 1thes 1th
2Thess | 2 Thessalonians | 2. Thessalonicher | 2Th | 2thes 2th
1Tim | 1 Timothy | 1. Timotheus | 1Ti | 1ti
2Tim | 2 Timothy | 2. Timotheus | 2Ti | 2ti
Titus | Titus | Titus | Tit | tit
Phlm | Philemon | Philemon | Phm | phm
Heb | Hebrews | Hebräer | Heb | hebr
Jas | James | Jakobus | Jak | jak jam
1Pet | 1 Peter | 1. Petrus | 1Pe | 1petr 1pt 1pe
2Pet | 2 Peter | 2. Petrus | 2Pe | 2petr 2pt 2pe
1John | 1 John | 1. Johannes | 1Jo | 1joh 1jn
2John | 2 John | 2. Johannes | 2Jo | 2joh 2jn
3John | 3 John | 3. Johannes | 3Jo | 3joh 3jn
Jude | Jude | Judas | Jud | jud
Rev | Revelation | Offenbarung | Off | offb apk rv
"""
ROWS = [[cell.strip() for cell in row.split("|")] for row in NAMES.strip().splitlines()]
SHORT = [row[3] for row in ROWS]


def book_key(name: str) -> str:
    out = re.sub(r"[. \t]", "", name.lower())
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = out.replace(a, b)
    return out


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    book: int
    chapter: int
    verse: int | None
    last: int | None

    def osis(self) -> str:
        head = f"{BOOKS[self.book]}.{self.chapter}"
        if self.verse is None:
            return head
        return f"{head}.{self.verse}" + (f"-{head}.{self.last}" if self.last is not None else "")

    def concise(self) -> str:
        head = f"{SHORT[self.book]} {self.chapter}"
        if self.verse is None:
            return head
        return f"{head},{self.verse}" + (f"-{self.last}" if self.last is not None else "")


# Words that announce a chapter or verses.
CHAPTER_WORDS = (r"Kapitel", r"Kap\.", r"Kap ", r"chapter", r"ch\.")
VERSE_WORDS = (r"Vv\.", r"V\.", r"Verse", r"Vers", r"vv\.", r"v\.")
_SPELLED = (("ae", "(?:ae|ä)"), ("oe", "(?:oe|ö)"), ("ue", "(?:ue|ü)"), ("ss", "(?:ss|ß)"))
_COUNT = "0*[1-9][0-9]*"
_OPEN, _SHUT = r"(?<![^\W_])", r"(?![^\W_])"
_TAIL = re.compile(r"(?P<mark>[-–.])(?P<gap>\s*)(?P<n>[0-9]+)")
_DIGIT, _LEADS = re.compile("[0-9]"), re.compile(r"[^\W\d_]|[\s.,:]")


class Names:
    """Normalised names to canon positions, and the patterns that find them."""

    def __init__(self, more: dict[str, int] | None = None):
        self.at: dict[str, int] = {}
        for i, (osis, english, german, short, further) in enumerate(ROWS):
            self.at |= {book_key(n): i for n in (osis, english, german, short, *further.split())}
        self.at |= {book_key(n): i for n, i in (more or {}).items()}
        name = "|".join(self._spelling(k) for k in sorted(self.at, key=len, reverse=True))
        book = rf"(?i:{name})(?![^\W\d_])"
        words, verses = "|".join(CHAPTER_WORDS), "|".join(VERSE_WORDS)
        self.reference = re.compile(
            rf"{_OPEN}(?:(?i:{words})\s*(?P<chapter>{_COUNT})(?:[,:](?P<chapter_verse>{_COUNT}))?"
            rf"|(?:{verses})\s*(?P<verse>0*[1-9][0-9]*)(?![0-9])(?:(?P<on>ff?\.)|(?:-|–| und | u\. )(?P<upto>[0-9]{{1,3}})(?![0-9]))?"
            rf"|(?P<book>{book})\s*(?:[,:.]\s*)?(?P<book_chapter>{_COUNT})(?:[,:]\s*(?P<book_verse>{_COUNT}))?"
            rf"|(?<!,)(?P<pair>{_COUNT})[,:](?P<pair_verse>{_COUNT}))"
        )
        self.whole = re.compile(
            rf"(?P<book>{book})(?P<rest>\s*(?:[,:.]\s*)?(?:(?P<c>[0-9]+)\s*(?:[,:.]?\s*(?P<v>[0-9]+)\s*(?:(?P<dash>[-–])\s*(?P<same>{book}\.[0-9]+\.)?(?P<last>[0-9]+)?)?)?)?)(?P<more>.*)",
            re.DOTALL,
        )
        # Before its first digit a reference has letters, spaces and stops only, and no more letters than the longest name or word.
        self.lettered = all(re.fullmatch(r"[0-9]?[^\W\d_]+", key) for key in self.at)
        self.longest = max(map(len, (*self.at, *CHAPTER_WORDS, *VERSE_WORDS)))

    def first(self, text: str, at: int) -> re.Match | None:
        """The leftmost reference that begins at ``at`` or later. The pattern is tried only where a digit follows near enough."""
        if not self.lettered:
            return self.reference.search(text, at)
        while digit := _DIGIT.search(text, at):
            begin, letters = digit.start(), 0
            while begin > at and letters <= self.longest and _LEADS.match(text, begin - 1):
                begin -= 1
                letters += text[begin].isalpha()
            for start in range(begin, digit.end()):
                if m := self.reference.match(text, start):
                    return m
            at = digit.end()
        return None

    @staticmethod
    def _spelling(key: str) -> str:
        """A pattern of a normalised name: dots and spaces after its number, spaces between letters, umlauts either way."""
        number, letters = re.fullmatch(r"([0-9]?)(.*)", key).groups()
        parts = re.findall("ae|oe|ue|ss|.", letters)
        out = " *".join(dict(_SPELLED).get(p, re.escape(p)) for p in parts)
        return f"{number}[. ]*{out}" if number else out

    def book(self, name: str) -> int:
        return self.at[book_key(name)]


@lru_cache
def built_in() -> Names:
    return Names()


def _reach(text: str, end: int, verse: int, spaced: bool) -> tuple[int, int | None]:
    """How far a verse's range and dotted list go, and the last verse of it. Only rising numbers belong to it."""
    last, ranged = None, False
    while m := _TAIL.match(text, end):
        n, dotted = int(m["n"]), m["mark"] == "."
        if dotted and m["gap"] or not dotted and (ranged or m["gap"] and not spaced):
            break
        rises = n > (last or verse) if dotted or last else n >= verse
        if not rises or dotted and re.match(r"\w", text[m.end() : m.end() + 1]):
            break
        end, last, ranged = m.end(), n, not dotted
    return end, last


def scan(text: str, names: Names, book: int | None = None, chapter: int | None = None) -> Iterator[Found]:
    """References in prose from left to right, relative to a book and chapter at hand."""
    recent, at = book, 0
    while m := names.first(text, at):
        end, g, last = m.end(), m.groupdict(), None
        at = m.start() + 1
        if g["verse"]:
            if book is None or chapter is None or len(g["verse"]) > 3:
                continue
            n, upto = int(g["verse"]), int(g["upto"] or 0)
            if upto <= n and not g["on"]:
                end = m.end("verse")
            place = (book, chapter, n, upto if upto > n else None)
        else:
            own = names.book(g["book"]) if g["book"] else recent
            if own is None:
                continue
            verse = g["book_verse"] or g["chapter_verse"] or g["pair_verse"]
            if verse:
                end, last = _reach(text, end, int(verse), bool(g["book"]))
            place = (own, int(g["book_chapter"] or g["chapter"] or g["pair"]), int(verse) if verse else None, last)
        if text[end : end + 1].isalnum() and not (g["verse"] and end == m.end() and m["on"]):
            continue
        yield Found(m.start(), end, *place)
        recent, at = place[0], end


def parse(text: str, names: Names) -> tuple[str | None, str | None]:
    """(osis, None) or (None, error) of a string that is one whole reference."""
    text = text.strip()
    if not text:
        return None, "Empty"
    m = names.whole.match(text)
    if not m:
        return None, "UnknownBook"
    book, c, v, last = names.book(m["book"]), m["c"], m["v"], m["last"]
    if not c:
        return None, "MissingChapter"
    if any(n and not 0 < int(n) < 65536 for n in (c, v)):
        return None, "InvalidNumber"
    if m["dash"]:
        if not last or m["same"] not in (None, f"{BOOKS[book]}.{c}."):
            return None, "InvalidRange"
        if not 0 < int(last) < 65536:
            return None, "InvalidNumber"
        if int(last) < int(v):
            return None, "InvalidRange"
    if m["more"]:
        return None, "Trailing"
    return Found(0, m.end(), book, int(c), int(v) if v else None, int(last) if last else None).osis(), None


def parse_udf(names: Names):
    @F.pandas_udf("osis string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t or "", names) for t in texts], columns=["osis", "error"])

    return run


def scan_udf(names: Names, after: str = ""):
    """Of (text, context_book osis or null, context_chapter or null): byte ranges and OSIS forms of the references that stand right after ``after``."""

    @F.pandas_udf("array<struct<start: int, end: int, osis: string, concise: string>>")
    def run(texts: pd.Series, books: pd.Series, chapters: pd.Series) -> pd.Series:
        out = []
        for text, osis, chapter in zip(texts, books, chapters, strict=True):
            text = text or ""
            place = BOOKS.index(osis) if isinstance(osis, str) else None
            rows, at, size = [], 0, 0
            for f in scan(text, names, place, int(chapter) if pd.notna(chapter) else None):
                start = size + len(text[at : f.start].encode())
                at, size = f.end, start + len(text[f.start : f.end].encode())
                if text.endswith(after, 0, f.start):
                    rows.append({"start": start, "end": size, "osis": f.osis(), "concise": f.concise()})
            out.append(rows)
        return pd.Series(out)

    return run


def category(book: Column) -> Column:
    from ..schema import CATEGORIES

    out = F.lit(CATEGORIES[-1][1])
    for last, name in reversed(CATEGORIES[:-1]):
        out = F.when(book <= last, F.lit(name)).otherwise(out)
    return F.when((book >= 0) & (book < len(BOOKS)), out)
