import pytest
from pyspark.sql import functions as F

from codexloom.operators import documents as d
from codexloom.operators import library, lines, store
from codexloom.plans.golden_queries import NAMES
from codexloom.schema import canon

FRAGMENT = "doc_id long, page int, x double, y double, size double, width double, text string"


def test_lines_profile_and_furniture(spark):
    rows = []
    for page in range(4):
        rows += [(1, page, 50.0, 20.0, 8.0, 40.0, f"Chapter one {page}"), (1, page, 300.0, 790.0, 8.0, 5.0, str(page + 1))]
        rows += [(1, page, 50.0, 100.0, 16.0, 60.0, "A big"), (1, page, 50.0, 118.0, 16.0, 60.0, "heading")]
        rows += [(1, page, 50.0, 200.0 + 14 * i, 10.0, 100.0, "some body text here") for i in range(10)]
        rows += [(1, page, 155.0, 201.0, 10.0, 40.0, "joined")]
    frag = spark.createDataFrame(rows, FRAGMENT)
    placed = frag.withColumns({"rise": F.lit(0.0), "bold": F.lit(False), "italic": F.lit(None).cast("boolean")})
    found = lines.lines(placed).withColumnsRenamed({"left": "x", "top": "y"})
    assert found.filter("page = 0 and text = 'some body text here joined'").count() == 1
    kept = d.without_furniture(found)
    assert not {"1", "Chapter one 0"} & {r["text"] for r in kept.collect()}
    p = d.profile(kept).first()
    assert (p["body_size"], p["left_edge"], p["right_edge"]) == (10.0, 50.0, 150.0)
    heads = d.heading_level(kept).orderBy("page").collect()
    assert [(h["level"], h["text"]) for h in heads] == [(1, "A big heading")] * 4


def test_gutter(spark):
    rows = [(1, 0, x, float(y), 10.0, 80.0, "t") for y in range(5) for x in (10.0, 110.0)]
    g = d.gutter(spark.createDataFrame(rows, FRAGMENT)).first()
    assert 90 <= g["gutter_from"] < g["gutter_to"] <= 110


def test_verses_and_paragraph_flags(spark):
    blocks = spark.createDataFrame([(1, 0, "heading", "Genesis 1"), (1, 1, "paragraph", "1 In the 2 And the 12 sons"), (1, 2, "paragraph", "3 Then"), (1, 3, "paragraph", "goes on 1 Thus")], "doc_id long, pos int, kind string, text string")
    got = d.verses(blocks).orderBy("chapter", "verse").collect()
    assert [(r["chapter"], r["verse"], r["text"], r["paragraph"]) for r in got] == [(1, 1, "In the", True), (1, 2, "And the 12 sons", False), (1, 3, "Then goes on", True), (2, 1, "Thus", False)]
    many = spark.createDataFrame([(1, 1, v, "t", True) for v in range(1, 30)], d.VERSES)
    assert d.settled_paragraphs(many).filter("paragraph").count() == 0
    assert d.settled_paragraphs(many.filter("verse < 10")).filter("paragraph").count() == 9


def test_commentary_and_kind(spark):
    blocks = spark.createDataFrame([(1, 0, "heading", "Joh 3,16-18 Love"), (1, 1, "paragraph", "a"), (1, 2, "paragraph", "b"), (1, 3, "heading", "Ps 23,1"), (1, 4, "paragraph", "c")], "doc_id long, pos int, kind string, text string")
    got = d.commentary(blocks, "John", NAMES).collect()
    assert [(r["book"], r["chapter"], r["verse_start"], r["verse_end"], r["text"]) for r in got] == [(42, 3, 16, 18, "a\n\nb"), (18, 23, 1, 1, "c")]
    f = spark.createDataFrame([(60, 2, 100, False, 0, 0, 9, 0), (0, 0, 9, True, 10, 0, 9, 0), (0, 0, 9, True, 2, 3, 90, 0), (0, 0, 9, False, 50, 9, 9, 9)], "verse_numbers int, chapters int, paragraphs int, has_subject boolean, scripture int, refs int, sampled int, refs_sampled int")
    assert [r["kind"] for r in d.detected(f).collect()] == ["bible", "commentary", "commentary", "book"]


def test_store(spark, tmp_path):
    path = str(tmp_path / "verse")
    shape = "code string, book int, chapter int, verse int, pos int, text string, paragraph boolean"
    rows = spark.createDataFrame([("A", 0, 1, 1, 0, "x", True), ("A", 0, 1, 1, 1, "y", False), ("B", 0, 1, 1, 2, "z", False)], shape)
    store.replace_module(store.bible_rows(rows, joined=True), path)
    store.replace_module(store.bible_rows(spark.createDataFrame([("B", 0, 1, 1, 0, "new", False), ("B", 0, 1, 1, 1, "last", True)], shape), joined=False), path)
    got = {(r["code"], r["text"], r["paragraph"]) for r in spark.read.parquet(path).collect()}
    assert got == {("A", "x y", True), ("B", "last", True)}
    assert [r["code"] for r in store.delete_module(spark, path, "A").collect()] == ["B"]
    with pytest.raises(library.UnknownModule):
        store.delete_module(spark, path, "C")
    titles = spark.createDataFrame([("A", "t")], "code string, title string")
    assert store.renamed(titles, "A", " new ").first()["title"] == "new" and store.renamed(titles, "A", " ").isEmpty()


def test_merged_commentary(spark):
    e = spark.createDataFrame([("A", 0, 1, 1, 2, 0, None, "Ä b"), ("A", 0, 1, 1, 5, 1, "H", "c")], "code string, book int, chapter int, verse_start int, verse_end int, pos int, heading string, text string")
    r = spark.createDataFrame([("A", 0, 1, 1, 1, 0, 1, "Gen.1"), ("A", 0, 1, 1, 0, 0, 2, "Gen.2")], "code string, book int, chapter int, verse_start int, pos int, ref_start int, ref_end int, osis string")
    m = store.merged_entries(e)
    row = m.first()
    assert (row["verse_end"], row["heading"], row["text"]) == (5, "H", "Ä b\n\nc")
    refs = store.shifted_refs(r, m)
    assert [(x["seq"], x["ref_start"], x["osis"]) for x in refs.orderBy("seq").collect()] == [(1, 0, "Gen.2"), (2, 6, "Gen.1")]
    assert [x["osis"] for x in store.comments_with_refs(m, refs.withColumn("seq", F.col("seq").cast("int"))).first()["refs"]] == ["Gen.2", "Gen.1"]


def test_library_views(spark):
    verses = spark.createDataFrame([(0, 1, v, "t") for v in range(1, 6)], "book int, chapter int, verse int, text string")
    got = library.preview(verses, {"book": 0, "chapter": 1}, 3, 4).collect()
    assert [(r["verse"], r["marked"]) for r in got] == [(2, False), (3, True), (4, True), (5, False)]
    notes = spark.createDataFrame([(0, 1, 2, 1, 9, "b"), (0, 1, 1, 1, 0, "a"), (0, 1, 9, 1, 0, "c")], "book int, chapter int, verse int, seq int, offset int, text string")
    labels = {r["text"]: r["label"] for r in library.note_view(notes, verses, ["book", "chapter", "verse"]).collect()}
    assert labels == {"a": "a", "b": "b", "c": "9"}
    marks = spark.createDataFrame([("m1", '{"book":"Exod","chapter":1,"verseStart":1,"created":"2"}'), ("m2", '{"book":"Gen","chapter":2,"verseStart":1,"created":"1"}'), ("m3", ""), ("m4", "x"), ("m5", '{"book":"Nope","chapter":1}')], "key string, value string")
    assert [r["key"] for r in library.overview(marks, canon(spark)).collect()] == ["m2", "m1", "m5"]
    spine = spark.createDataFrame([(0, c) for c in range(1, 8)], "book int, chapter int")
    assert [r["row"] for r in library.selector_rows(spine, 3).orderBy("chapter").collect()] == [0, 0, 0, 1, 1, 1, 2]
    m = spark.createDataFrame([("k", "A", 0, 1, 1, 3, 2, 5)], "key string, origin string, book int, chapter int, verse_start int, verse_end int, start_offset int, end_offset int")
    rows = [("A", 0, 1, 1, 0, 2), ("A", 0, 1, 1, 3, 4), ("A", 0, 1, 2, 0, 2), ("A", 0, 1, 2, 8, 9), ("A", 0, 1, 3, 4, 7), ("A", 0, 1, 3, 5, 7), ("A", 1, 1, 2, 0, 2), ("A", 0, 2, 2, 0, 2), ("B", 0, 1, 2, 0, 2), ("B", 0, 1, 1, 0, 2), ("B", 0, 1, 4, 0, 9)]
    runs = spark.createDataFrame(rows, "module string, book int, chapter int, verse int, start int, end int")
    hit = library.covered(m, runs, "origin")
    assert sorted((r["module"], r["book"], r["verse"], r["start"]) for r in hit.collect()) == [("A", 0, 1, 3), ("A", 0, 2, 0), ("A", 0, 2, 8), ("A", 0, 3, 4), ("B", 0, 1, 0), ("B", 0, 2, 0)]
