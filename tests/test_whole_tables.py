"""Queries over whole tables, against brute force; with large, repeated and null ids."""

import pytest
from pyspark.sql import functions as F

from codexloom.plans import registry

DOCS = [(0, "a bb", 4), (51, "one\ntwo three four five six\n\n\n\nnext page", 43), (9_000_001, "x", 1), (500, "y" * 21, 21), (550, "z", 1), (600, None, None), (None, "n", 1)]
LABELS = [(4, 1, 0), (59, 1, 1), (60, 1, 1), (701, 0, 0), (80_003, 0, 1), (80_004, 2, 1)]
TURNS = [(0, 0, "a"), (999_999, 1, "b"), (1_000_000, 0, "c"), (5_000_000_000, 3, "d"), (None, 2, "e")]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    for name, rows, shape in (
        ("documents", DOCS, "doc_id long, text string, n_chars long"),
        ("labels", LABELS, "doc_id long, quality int, toxic int"),
        ("conversations", [(*t, "user") for t in TURNS], "conv_id long, turn int, text string, role string"),
    ):
        spark.createDataFrame(rows, shape).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def rows_of(spark, place, name):
    return [tuple(r) for r in registry.queries()[name](spark, place).collect()]


def test_all_rows_keeps_large_and_null_ids(spark, place):
    assert sorted(rows_of(spark, place, "all_rows"), key=str) == sorted(TURNS, key=str)


def test_located_notes(spark, place):
    expected = []
    for conv, turn, text in TURNS:
        books = [i for i, _, n in DOCS if None not in (i, n, conv) and i % 50 == conv % 50 and n % 20 == len(text) % 20]
        expected += [(conv, turn, "user", max(books))] if books else []
    assert {r[0] for r in expected} == {0, 1_000_000, 5_000_000_000} and {r[3] for r in expected} == {550}
    assert sorted(rows_of(spark, place, "located_notes"), key=str) == sorted(expected, key=str)


def test_page_gutters(spark, place):
    expected = []
    for doc, text, _ in DOCS:
        lines = (text or "").split("\n")
        for page in range(0, len(lines), 5):
            words = [(i % 7 * 100 + len(w), 6 * len(w)) for line in lines[page : page + 5] for i, w in enumerate(line.split(" "))]
            bins = sorted({b for x, width in words for b in range(x // 4, (x + width) // 4 + 1)})
            gaps = [(b - a, -a, b) for a, b in zip(bins[:-1], bins[1:], strict=True) if b > a + 1]
            if gaps:
                _, a, b = max(gaps)
                expected.append((doc, page // 5, (1 - a) * 4.0, b * 4.0))
    assert {(r[0], r[1]) for r in expected} == {(0, 0), (51, 0), (51, 1)}
    assert sorted(rows_of(spark, place, "page_gutters")) == sorted(expected)


def test_image_gap_fill(spark, place):
    sizes = {}
    for doc, quality, toxic in LABELS:
        key = (quality, toxic * 2 + doc % 7 * 3)
        width, height = sizes.get(key, (0, 0))
        sizes[key] = (max(width, doc), max(height, toxic))
    expected = [(q, i, *sizes.get((q, i), (0, 0))) for q in {k[0] for k in sizes} for i in range(max(i for k, i in sizes if k == q) + 1)]
    assert sorted(rows_of(spark, place, "image_gap_fill")) == sorted(expected)


def test_references_of_the_lines_themselves_are_not_between_lines(spark, tmp_path):
    from duckdb import connect

    rows = [(1, "c'est 43\nhab 3", 14), (66, "a (vgl. Joh 3,16) 7,1\n (vgl. Joh 3,16)\nest\n43,1 ü\nV. 5", 40), (7, "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = duck.sql(registry.oracle_sql()["reference_scan_golden"]).fetchall()
    assert sorted(rows_of(spark, str(tmp_path), "reference_scan_golden")) == sorted(expected)


@pytest.mark.parametrize("again", [False, True])
def test_terms_are_counted_inside_rows(spark, again):
    from collections import Counter

    from codexloom.operators import search

    rows = [(1, "b a b ab1 liebe Liebt"), (2, None), (3, ""), (None, "a"), *([(1, "a b"), (None, "c a")] if again else [])]
    found = search.term_frequencies(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    assert ("Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()) == again
    expected = Counter((k, {"liebe": "lieb", "liebt": "lieb"}.get(w, w)) for k, t in rows for w in (t or "").lower().split())
    assert {(k, t): n for k, t, n in found.collect()} == expected
    assert found.count() == len(expected)


def test_only_titles_are_joined_for_titles(spark):
    from codexloom.operators import verses

    rows = [(1, 0, 0, "start", 1, 2, None, "Kap"), (1, 1, 0, "title", None, None, None, " T "), (1, 2, 0, "text", None, None, 1, "x"), (1, 3, 0, "title", None, None, None, "U"), (1, 4, 0, "text", None, None, 2, "y")]
    _, titles = verses.verses(spark.createDataFrame(rows, "doc_id long, pos long, part int, kind string, book int, chapter int, number int, text string"))
    assert sorted(map(tuple, titles.select("ordinal", "seq", "text").collect())) == [(3, 1, "T"), (5, 1, "U")]
    assert "text,start" in titles._jdf.queryExecution().optimizedPlan().toString().replace(" ", "").replace("start,text", "text,start")


def test_wide_fragments_are_no_rows(spark):
    from codexloom.operators import documents

    rows = [(1, 0, 0.0, 4e12), (1, 0, 4e12 + 40, 8.0), (1, 0, 4e12 + 100, -20.0), (1, 0, None, 4.0), (1, 1, 8.0, 0.0)]
    found = documents.gutter(spark.createDataFrame(rows, "doc_id long, page long, x double, width double")).collect()
    assert [tuple(r) for r in found] == [(1, 0, 4e12 + 4, 4e12 + 40)]


def test_labels_are_read_before_lines_meet_their_profile(spark, monkeypatch):
    from codexloom.operators import footnotes

    seen, cut = [], footnotes.cut
    monkeypatch.setattr(footnotes, "cut", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    rows = [(1, 0, 0, 100.0, 10.0, False, "body"), (1, 1, 0, 700.0, 8.0, False, "3 note"), (1, 2, 0, 710.0, 8.0, False, "more")]
    lines = spark.createDataFrame(rows, "doc_id long, pos long, page long, top double, size double, bold boolean, text string")
    found = footnotes.notes(footnotes.split(lines, lines.select("doc_id").distinct().withColumn("body_size", F.lit(10.0))))
    assert [tuple(r) for r in found.select("note", "label", "text").collect()] == [(1, "3", "note more")]
    assert seen[0].index("Join") < seen[0].index("regexp")
