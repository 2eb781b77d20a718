"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes in the order in which they are tried.
SUFFIXES = ("ern", "em", "en", "er", "es", "e", "n", "t")
# Aliases of folded tokens.
ALIASES = {
    "beladen": "belastet", "beschwert": "belastet", "erholt": "ruhe", "erholen": "ruhe", "erquicklich": "ruhe", "erquicken": "ruhe",
    "fehlt": "mangel", "fehlen": "mangel", "friedfertig": "frieden", "friedfertige": "frieden", "friedfertigen": "frieden", "geplagt": "belastet",
    "geduld": "langmutig", "geduldig": "langmutig", "geliebt": "lieb", "gezeigt": "lieb", "glucklich": "selig", "guetig": "freundlich",
    "hirte": "hirt", "jahwe": "herr", "lasten": "last", "liebe": "lieb", "liebt": "lieb", "mangelt": "mangel", "muehselig": "belastet",
    "sorge": "sorg", "sorgen": "sorg", "sorget": "sorg", "sorgt": "sorg", "zuversichtlich": "zuversich",
}


def _folds() -> tuple[str, str, dict[str, str]]:
    """By rule, from Unicode's compatibility decomposition: characters that fold to one ASCII character, and to more."""
    one, to, many = [], [], {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if ord(c) < 128)
        if len(plain) == 1:
            one.append(chr(code))
            to.append(plain)
        elif plain:
            many[chr(code)] = plain
    return "".join(one), "".join(to), many


_ONE, _TO, _MANY = _folds()
#: One of them. What Latin texts are made of is ruled out by a class of three ranges before the long class is tried.
_WIDE = r"(?=[^\x00-\xbb\xbf-\x{131}])[" + "".join(f"\\x{{{ord(c):x}}}" for c in _MANY if ord(c) > 0x131) + r"]|[\xbc-\xbe]"


def fold(text: Column) -> Column:
    """Compatibility decomposition, non-ASCII dropped, lower case. ASCII texts are only lower-cased; characters that fold to
    several are cut out of the texts that have them, and looked up."""
    table = F.create_map(*[F.lit(x) for pair in _MANY.items() for x in pair])
    parts = F.split(F.regexp_replace(text, f"({_WIDE})", "\x01$1\x01"), "\x01")
    apart = F.array_join(F.transform(parts, lambda p: F.when(F.length(p) == 1, F.coalesce(F.try_element_at(table, p), p)).otherwise(p)), "")
    narrow = F.when(text.rlike(_WIDE), apart).otherwise(text)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.lower(F.regexp_replace(F.translate(narrow, _ONE, _TO), r"[^\x00-\x7F]+", "")))


def strip_suffix(token: Column) -> Column:
    """The first suffix that leaves four characters goes."""
    out = token
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        out = F.when(F.endswith(token, F.lit(suffix)) & (F.length(token) >= n + 4), F.left(token, F.length(token) - n)).otherwise(out)
    return out


def _stripped(word: str) -> str:
    return next((word[: -len(x)] for x in SUFFIXES if word.endswith(x) and len(word) >= len(x) + 4), word)


#: All words that have an alias, as they are or without their suffix.
_ALIASED = {w: ALIASES.get(w) or ALIASES[_stripped(w)] for a in ALIASES for x in ("", *SUFFIXES) for w in [a + x] if w in ALIASES or _stripped(w) in ALIASES}


def canonical(token: Column) -> Column:
    """A token's alias, or that of the token without its suffix, or the token without its suffix."""
    table = F.create_map(*[F.lit(x) for pair in _ALIASED.items() for x in pair])
    return F.when(token.isin(*_ALIASED), F.try_element_at(table, token)).otherwise(strip_suffix(token))


def words(text: Column) -> Column:
    """A text's folded words in order, before suffixes and aliases; null gives none."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def tokens(text: Column) -> Column:
    """Searchable tokens of a text, in order; null gives none."""
    return F.transform(words(text), canonical)


def forms(term: str) -> list[str]:
    """All words that can have this token: the term and its aliases, each also with a suffix."""
    stems = [term, *(a for a, to in ALIASES.items() if to == term)]
    return [stem + suffix for stem in stems for suffix in ("", *SUFFIXES)]


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def book_key(name: Column) -> Column:
    """Normalised book name: lower case, no dots, spaces or tabs, umlauts written out."""
    out = F.regexp_replace(F.lower(name), r"[. \t]", "")
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of the UTF-8 text; null where the range is outside or cuts a character."""
    whole = F.encode(text, "UTF-8")
    raw = F.substring(whole, start + 1, end - start)
    # The byte at the start opens a character, also where the range is empty.
    inside = (start >= 0) & (end >= start) & (end <= F.octet_length(text)) & ~F.hex(F.substring(whole, start + 1, F.lit(1))).rlike("^[89AB]")
    return F.when(inside & F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def has_word(text: Column, word: Column) -> Column:
    """Whether a whole word, case-folded, occurs."""
    return F.exists(F.split(F.lower(text), r"[^\p{L}\p{N}]"), lambda w: w == F.lower(word))


def lookup_word(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), F.lit(""))


def display_key(key: Column, sort: Column) -> Column:
    return F.when(key.rlike("^[0-9]+$"), F.concat(F.lit("G"), sort.cast("string"))).otherwise(key)


def title_from_filename(path: Column) -> Column:
    """The stem's words without numbers and filler; the first letter upper case."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    words = F.filter(F.split(stem, r"[_\- ]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$") & ~F.lower(w).isin("download", "ebook", "pdf", "epub", "final"))
    joined = F.array_join(words, " ")
    return F.concat(F.upper(F.left(joined, F.lit(1))), F.substring(joined, F.lit(2), F.length(joined)))


def module_code(title: Column) -> Column:
    """Capitalised words, ASCII letters and digits only, 16 characters; ``Document`` if nothing is left."""
    words = F.transform(F.split(title, r"(?U)[^\p{L}\p{N}]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    plain = F.regexp_replace(F.translate(F.array_join(words, ""), "äöüÄÖÜß", "aouAOUs"), "[^A-Za-z0-9]", "")
    return F.coalesce(F.nullif(F.left(plain, F.lit(16)), F.lit("")), F.lit("Document"))


def marker_label(index: Column) -> Column:
    """Bijective base 26 of an index from 0: a..z, aa, ab.., for any long (14 letters)."""
    letter = lambda n: F.char((F.pmod(n - 1, F.lit(26)) + 97).cast("int"))
    start = F.struct((index + 1).cast("long").alias("n"), F.lit("").alias("out"))
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).cast("long").alias("n"), F.concat(letter(a["n"]), a["out"]).alias("out"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["out"])


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
