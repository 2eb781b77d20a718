"""Footnotes against a reader that goes line by line."""

import random
import re

import pytest

from codexloom.operators import footnotes

LINE = "doc_id int, pos long, page int, top double, size double, bold boolean, text string, note int, label string"


def lines_of(rng):
    out, page, top = [], 0, 0.0
    for pos in range(rng.randint(0, 80)):
        top += 90.0
        if top > 800:
            page, top = page + rng.choice([1, 1, 1, 1, 2]), 0.0
        out.append((pos, page, top, rng.choice([8.0, 8.0, 10.0] if top > 400 else [10.0, 10.0, 8.0]), rng.random() < 0.1, rng.choice(["12 Note", "3. Note.", "a vgl.", "geht wei-", "ter so", "Ende", "1999 Jahr", "b"])))
    return out


def label_of(text):
    m = re.match(r"[a-z](?= )|[0-9]{1,3}(?=\.?[  ])", text)
    return m and m[0]


def read(lines):
    """note of each line; a note's page is that of its last line."""
    out, n, last, block = {}, 0, None, None
    for pos, page, top, size, bold, text in lines:
        small, label = size < 10.0 - 1.2, label_of(text)
        if block is not None and (block != page or not small):
            block = None
        if block is None and small and top > 400 and not bold and (label or (last is not None and last + 1 == page)):
            block = page
        if block is not None:
            n, last = n + (label is not None), page
        out[pos] = n if block is not None else None
    return out


@pytest.mark.parametrize("size", [1, 5, 4096])
def test_split(spark, size):
    rng = random.Random(3)
    docs = {d: lines_of(rng) for d in range(50)}
    rows = [(d, *line, 7, "clash") for d, lines in docs.items() for line in lines] + [(None, 0, 0, 0.0, 8.0, False, "1 x", 0, ""), (0, 900, None, 500.0, 8.0, None, None, 0, "")]
    profile = spark.createDataFrame([(d, 10.0) for d in docs], "doc_id int, body_size double")
    got = footnotes.split(spark.createDataFrame(rows, LINE).repartition(5), profile, size=size).collect()
    assert {(r.doc_id, r.pos): r.note for r in got} == {(d, pos): note for d, lines in docs.items() for pos, note in read(lines).items()}
    assert all((r.label == label_of(r.text)) if r.note else r.label is None for r in got)


def test_a_note_over_three_pages(spark):
    texts = ["Text", "7. Anfang der No-", "te, die weit", "Text", "geht und", "Text", "endet."]
    pages, sizes, tops = [1, 1, 1, 2, 2, 3, 3], [10.0, 8.0, 8.0, 10.0, 8.0, 10.0, 8.0], [10.0, 700.0, 710.0, 10.0, 700.0, 10.0, 700.0]
    rows = [(1, i, p, t, s, None, x, None, None) for i, (p, t, s, x) in enumerate(zip(pages, tops, sizes, texts, strict=True))]
    profile = spark.createDataFrame([(1, 10.0)], "doc_id int, body_size double")
    for size in (1, 4096):
        found = footnotes.split(spark.createDataFrame(rows, LINE).repartition(3), profile, size=size)
        assert [tuple(r) for r in footnotes.notes(found).collect()] == [(1, 1, 1, "7", "Anfang der Note, die weit geht und endet.")]


def test_bound(spark):
    notes = spark.createDataFrame([(1, 1, 3, "a", ""), (1, 2, 3, "a", ""), (1, 3, 5, "a", ""), (2, 1, 3, "a", "")], "doc_id int, note long, page long, label string, text string")
    marks = spark.createDataFrame([(1, 2, "a", "m0"), (1, 3, "a", "m1"), (1, 4, "a", "m2"), (1, 6, "a", "m3"), (1, 3, "b", "m4"), (2, 3, "a", "m5"), (None, 3, "a", "m6")], "doc_id int, page long, label string, name string")
    assert {r.name: r.note for r in footnotes.bound(marks, notes).collect()} == {"m0": 1, "m1": 1, "m2": 3, "m3": None, "m4": None, "m5": 1, "m6": None}
