"""Schemas of the library's tables and the canon dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


L, I, S, B = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
_AT = {"module_id": L, "book": I, "chapter": I}
TABLES: dict[str, T.StructType] = {
    "module": _table(id=L, code=S, title=S, language=S, kind=S),
    "verse": _table(**_AT, verse=I, text=S, paragraph=B),
    "heading": _table(**_AT, verse=I, seq=I, level=I, text=S),
    "note": _table(**_AT, verse=I, seq=I, offset=I, text=S),
    "comment": _table(**_AT, verse_start=I, verse_end=I, heading=S, text=S, blocks=S),
    "comment_ref": _table(**_AT, verse_start=I, seq=I, ref_start=I, ref_end=I, osis=S),
    "dict_entry": _table(module_id=L, sort=I, key=S, headword=S, pron=S, text=S),
    "word_link": _table(**_AT, verse=I, seq=I, start=I, ref_end=I, strong=S),
    "book_section": _table(module_id=L, ordinal=I, level=I, name=S, heading=S, text=S, blocks=S),
    "plan": _table(name=S, source=S, json=S),
    "module_title": _table(code=S, title=S),
    "doc_image": _table(module_id=L, idx=I, media_type=S, data=T.BinaryType(), width=I, height=I),
    "kv": _table(key=S, value=S),
    "sync_state": _table(key=S, millis=L, counter=I, device=S),
}
#: One line of a device's log.
OP_LINE = _table(k=S, v=S, t=T.ArrayType(L), d=S)

# The 66 books' OSIS ids in canon order.
BOOKS = (
    "Gen Exod Lev Num Deut Josh Judg Ruth 1Sam 2Sam 1Kgs 2Kgs 1Chr 2Chr Ezra Neh Esth Job Ps Prov Eccl Song Isa Jer Lam Ezek Dan Hos Joel "
    "Amos Obad Jonah Mic Nah Hab Zeph Hag Zech Mal Matt Mark Luke John Acts Rom 1Cor 2Cor Gal Eph Phil Col 1Thess 2Thess 1Tim 2Tim Titus "
    "Phlm Heb Jas 1Pet 2Pet 1John 2John 3John Jude Rev"
).split()
# The last canon index of each category.
CATEGORIES = ((4, "Law"), (16, "HistoryOt"), (21, "Wisdom"), (26, "MajorProphets"), (38, "MinorProphets"), (42, "Gospels"), (43, "HistoryNt"), (64, "Epistles"), (65, "Apocalyptic"))


def category(book: int) -> str:
    return next(name for last, name in CATEGORIES if book <= last)


def canon(spark: SparkSession) -> DataFrame:
    """book, osis, category: a dimension of fixed size."""
    return spark.createDataFrame([(i, osis, category(i)) for i, osis in enumerate(BOOKS)], "book int, osis string, category string")
