"""Rules of imported documents, reading-desk queries and the store's writing side."""

import io
import struct
import zlib

from pyspark.sql import functions as F

from codexloom.functions import references as refs
from codexloom.functions import rules as u
from codexloom.operators import store, study


def column(spark, values, make):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_list_marks(spark):
    texts = ["1. one", " 12) two", "123. no", "• dot", "- dash", "a) letter", "A) no", "1.no", "1. ", "b. x"]
    assert column(spark, texts, u.list_mark) == ["1. ", " 12) ", None, "• ", "- ", "a) ", None, None, None, "b. "]
    assert column(spark, texts, u.list_number) == [1, 12, None, None, None, None, None, None, None, None]
    assert column(spark, texts, u.without_list_mark)[:4] == ["one", "two", "123. no", "dot"]


def test_leading_numbers(spark):
    assert column(spark, ["12 x", "2. x", "1234 x", " 7 "], u.leading_number) == [12, None, None, 7]
    assert column(spark, ["2. x", "2 x"], lambda c: u.leading_number(c, ".")) == [2, None]
    assert column(spark, ["V. 6.", "V.6a", "Vers 6", "V. 6x", "Vs 6", "Verse 1234"], u.verse_lead) == [6, 6, 6, None, None, None]
    assert column(spark, ["1.", " 176 ", "177", "0", "1 x"], lambda c: u.bold_number(c, F.lit(True))) == [1, 176, None, None, None]
    assert [x and tuple(x) for x in column(spark, ["(2,7) text ", "( 2 , 7 )", "(2.7) x", "x (2,7)"], u.locator)] == [(2, 7, "text"), (2, 7, ""), None, None]


def test_labels(spark):
    assert column(spark, ["12 ", "a,", "ab", "7)", "x1"], u.mark_label) == ["12", "a", "", "7", ""]
    assert column(spark, ["a (1,26)", "12 x", "3. x", "1234 x", "ab"], u.note_label) == ["a", "12", "3", None, None]
    assert [tuple(x) for x in column(spark, ["[a] x", "[] 12. y", "3) z", "plain"], u.without_note_label)] == [("a", "x"), ("12", "y"), ("3", "z"), ("", "plain")]


def test_lines_and_names(spark):
    rows = [("Wort\u00ad", "Teil", "WortTeil"), ("Wort- ", "teil", "Wortteil"), ("Wort-", "Teil", "Wort- Teil"), ("ein", "zwei", "ein zwei"), ("-", "a", "- a")]
    got = spark.createDataFrame(rows, "a string, b string, want string").select("want", u.hyphen_joined(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["x"] == r["want"] for r in got), got
    assert column(spark, ["ﬁnden ﬄ"], u.without_ligatures) == ["finden ffl"]
    assert column(spark, ["a%20b%", "x", "%C3%A4"], u.percent_decoded) == ["a b%", "x", "ä"]
    assert column(spark, ["../img/a%20b.png#f", "./x", "/y"], lambda c: u.joined_path(F.lit("OEBPS/text"), c)) == ["OEBPS/img/a b.png", "OEBPS/text/x", "OEBPS/text/y"]
    assert column(spark, ["t/Esth-4.html", "Ps-119.xhtml", "Foo-1.html", "Ps.html"], u.chapter_of_file) == ["Esth.4", "Ps.119", None, None]
    assert column(spark, ["a.PNG", "b.jpeg", "c.txt"], u.media_type) == ["image/png", "image/jpeg", "application/octet-stream"]
    assert column(spark, ["x verse", "vn", "my-verse-num", "over"], u.is_verse_class) == [True, True, True, False]
    assert column(spark, ["poline2", "x q2", "poetry", "polineX", "para"], u.poetry_indent) == [2, 2, 1, 1, None]
    assert column(spark, ["p", "span"], u.is_block_tag) == [True, False]
    assert [[tuple(w) for w in x] for x in column(spark, [" ä bc  d", ""], u.word_offsets)] == [[("ä", 1), ("bc", 4), ("d", 8)], []]
    row = spark.sql("SELECT X'8A' AS a, X'80' AS b").select(u.decoded(F.col("a"), "mac_roman").alias("a"), u.decoded(F.col("b"), "cp1252").alias("b")).first()
    assert tuple(row) == ("ä", "€")
    assert column(spark, ["ab"], lambda c: u.small_caps(c, F.lit(True))) == ["AB"]


def test_style_sheets(spark):
    css = "/* .no{font-weight:bold} */ .i, span.j {font-style: Italic} .b{font-weight:700;vertical-align:super} p .k{font-weight:bold} .h{display:none} .m{font-family:Courier New} .l{font-weight:400}"
    assert column(spark, [css, None], lambda c: u.class_styles_udf()(c)) == [{"i": ["italic"], "j": ["italic"], "b": ["bold", "superscript"], "h": ["hidden"], "m": ["monospace"]}, {}]


def test_picture_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x02\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"abcd" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 70) + b"\x03\0\0\0"
    rows = spark.createDataFrame([(0, bytearray(png)), (1, bytearray(jpeg)), (2, bytearray(zlib.compress(io.BytesIO(b"x").read())))], "i int, c binary")
    assert [r["s"] and tuple(r["s"]) for r in rows.select("i", u.picture_size_udf()("c").alias("s")).orderBy("i").collect()] == [(640, 480), (70, 30), (None, None)]


def test_reading_desk(spark):
    spine = spark.createDataFrame([(0, 1, "de-AT"), (8, 2, "en"), (45, 1, "de")], "book int, chapter int, language string")
    assert [(r["name"], r["abbrev"], r["category"]) for r in study.localized_spine(spine, F.col("language")).orderBy("book").collect()] == [("1. Mose", "1Mo", 0), ("1 Samuel", "1Sa", 1), ("1. Korinther", "1Ko", 7)]
    modules = spark.createDataFrame([("B", "bible"), ("A", "bible"), ("D", "dictionary")], "code string, kind string")
    assert [r["codes"] for r in study.modules_of_kind(modules).orderBy("place").collect()] == [["A", "B"], [], ["D"], [], []]
    verses = spark.createDataFrame([(42, 3, v, f"t{v}") for v in (2, 1)] + [(42, 4, 1, "x")], "book int, chapter int, verse int, text string")
    assert [r["text"] for r in study.chapter_of(verses, F.lit("Johannes 3,16-18")).collect()] == ["t1", "t2"]
    notes = spark.createDataFrame([(42, 3, 2, 1, 0, "vgl. Kap. 7,1; V. 4 und Ps 23"), (42, 3, 9, 1, 0, "kein")], "book int, chapter int, verse int, seq int, offset int, text string")
    got = {r["verse"]: (r["label"], [x["osis"] for x in r["refs"]]) for r in study.chapter_notes(notes, verses).collect()}
    assert got == {2: ("a", ["John.7.1", "John.3.4", "Ps.23"]), 9: ("9", [])}
    links = spark.createDataFrame([("B", 42, 3, 1, 1, "G26"), ("A", 42, 3, 2, 1, "G26"), ("A", 42, 3, 1, 2, "G26"), ("A", 42, 3, 1, 1, "G9")], "code string, book int, chapter int, verse int, seq int, strong string")
    own = verses.withColumn("code", F.explode(F.array(F.lit("A"), F.lit("B"))))
    assert [(r["code"], r["verse"]) for r in study.concordance_of(links, own, modules, "G26", 5).collect()] == [("A", 1), ("A", 2)]
    assert column(spark, ["G26", "00026", " g7 ", "q:x", "G", None], study.entry_anchor) == [26, 26, 7, None, None, None]
    assert column(spark, ["q:Liebe", "c:G26"], lambda c: study.anchor_after(c, "q")) == ["Liebe", None]
    assert column(spark, ["H1,G25,G26", "H1", ""], lambda c: study.lookup_anchor(F.lit("w"), F.split(c, ","))) == ["G25", "q:w", "q:w"]
    assert [r["i"] for r in study.listing(spark.range(10).withColumnRenamed("id", "i"), "i", 3, 2).collect()] == [3, 4]
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "g int, label string")
    assert {r["g"]: r["ambiguous"] for r in study.ambiguous_labels(labels, ["g"]).collect()} == {1: False, 2: True}
    assert study.table_of_contents(spark.createDataFrame([(2, 1, "b", "x"), (1, 0, "a", "y")], "ordinal int, level int, name string, text string")).first()["name"] == "a"


def test_desk_state(spark):
    steps = [(1, "go", "a"), (2, "go", "b"), (3, "go", "b"), (4, "go", "c"), (5, "back", None), (6, "back", None), (7, "back", None), (8, "forward", None), (9, "go", "d")]
    visits = spark.createDataFrame([("p", *s) for s in steps], "pane string, step int, action string, place string")
    assert [(r["places"], r["cursor"]) for r in study.history(visits).collect()] == [(["a", "b", "d"], 2)]
    assert [(r["places"], r["cursor"]) for r in study.history(visits.filter("step < 5"), 2).collect()] == [(["b", "c"], 1)]
    assert column(spark, ["1,3", "", ",".join(study.BADGES)], lambda c: study.next_badge(F.split(c, ","))) == ["2", "1", None]
    snap = lambda w, a=100.0: spark.range(1).select(study.snapped_width(F.lit(w), F.lit(20.0), F.lit(5.0), F.lit(a)).alias("x")).first()["x"]
    assert [snap(21.0), snap(44.0), snap(500.0), snap(50.0, 10.0), snap(32.5)] == [20.0, 45.0, 95.0, 50.0, 20.0]
    fit = lambda w: tuple(spark.range(1).select(study.fitted_measure(F.lit(w), 10.0, 2.0, 30.0, 12.0).alias("x")).first()["x"])
    assert [fit(640.0), fit(250.0), fit(20.0)] == [(2, 30.0), (0, 25.0), (0, 12.0)]
    colour = lambda h, c, n: spark.range(1).select(study.hcl(F.lit(h), F.lit(c), F.lit(n)).alias("x")).first()["x"]
    assert colour(15.0, 100.0, 65.0) == "#f8766d" and colour(0.0, 10.0, 0.0) == "#000000" and colour(0.0, 0.0, 100.0) == "#ffffff"


def test_store_writes(spark, tmp_path):
    module = spark.createDataFrame([("A", "t"), ("B", "u")], "code string, title string")
    verse = spark.createDataFrame([("A", 1), ("B", 2)], "code string, v int")
    paths = {"module": str(tmp_path / "module"), "verse": str(tmp_path / "verse")}
    module.write.parquet(paths["module"])
    verse.write.parquet(paths["verse"])
    left, titles = store.delete_module_whole(spark, paths, module, "A")
    assert {n: [r["code"] for r in t.collect()] for n, t in left.items()} == {"module": ["B"], "verse": ["B"]} and [r["code"] for r in titles.collect()] == ["B"]
    plans, gone = store.without_plan(spark.createDataFrame([("x",), ("y",)], "name string"), "x")
    assert gone and [r["name"] for r in study.plans_by_name(plans).collect()] == ["y"] and not store.without_plan(plans, "q")[1]
    kv = spark.createDataFrame([("label/b", "2"), ("label/a", "1"), ("label/c", ""), ("x", "3")], "key string, value string")
    assert [r["value"] for r in store.exported_labels(kv).collect()] == ["1", "2"]
    assert [r["value"] for r in store.plain_text(spark.createDataFrame([(0, "Gen", 1, 2, "b"), (0, "Gen", 1, 1, "a")], "book int, osis string, chapter int, verse int, text string")).collect()] == ["Gen 1:1 a", "Gen 1:2 b"]
    entries = spark.createDataFrame([("D", 1, 0, "old"), ("D", 1, 1, "new")], "code string, sort int, pos int, text string")
    assert [r["text"] for r in store.dictionary_rows(entries).collect()] == ["new"]
    assert [r["text"] for r in store.book_rows(entries.withColumnRenamed("sort", "ordinal")).collect()] == ["new"]
    comments = entries.select("code", F.lit(0).alias("book"), F.lit(1).alias("chapter"), F.col("sort").alias("verse_start"), "pos", "text")
    assert [r["text"] for r in store.commentary_rows(comments).collect()] == ["new"]
    assert refs.category(F.lit(0)) is not None
