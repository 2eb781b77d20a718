from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexloom.functions import references as refs
from codexloom.functions import text as tx
from codexloom.operators import layout
from codexloom.plans.golden_queries import NAMES
from codexloom.schema import BOOKS


def test_book_names_do_not_clash():
    assert len(BOOKS) == len(refs.SHORT) == 66
    assert len(refs.Names().at) >= 100
    for table in (BOOKS, refs.SHORT):
        keys = [refs.book_key(n) for n in table]
        assert len(set(keys)) == 66
    at = refs.Names().at
    assert all(at[refs.book_key(o)] == i for i, o in enumerate(BOOKS))


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_scanner_never_fails_and_spans_are_ordered(text):
    found = list(refs.scan(text, NAMES, 0, 3))
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))
    assert all(0 <= f.start < f.end <= len(text) for f in found)


@given(st.lists(st.sampled_from([*"123 .,:-–xäV\n", "est", "Kap. ", "K a p", "1. Mose", "Apg", "Vv. ", "John", "S o n g of", "٣", "Ko\u0308", "hohelied", "apostelgeschichte"]), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_first_reference_equals_a_search(text):
    for at in range(len(text) + 1):
        a, b = NAMES.first(text, at), NAMES.reference.search(text, at)
        assert (a and (a.span(), a.groups())) == (b and (b.span(), b.groups()))


def test_parsed_reference_parses_again():
    for text in ("Joh 3,16-18", "Ps 23", "1 Kor 13:4"):
        osis, _ = refs.parse(text, NAMES)
        assert refs.parse(osis.split("-")[0], NAMES) == (osis.split("-")[0], None)


def cost(items, width, breaks):
    """Demerits of a given break sequence, by the cost model; None where it is not allowed."""
    total, start, fit, flagged = 0.0, 0, 1, False
    for b in breaks:
        line = items[start:b]
        w = sum(i[1] for i in line if i[0] != layout.PENALTY) + (items[b][1] if items[b][0] == layout.PENALTY else 0)
        y, z = sum(i[2] for i in line), sum(i[3] for i in line)
        slack = width - w
        r = 0.0 if slack == 0 else (slack / y if y else float("inf")) if slack > 0 else (slack / z if z else float("-inf"))
        bad = min(100 * abs(r) ** 3, 10_000)
        if r < -1 or bad > 200 and items[b][4] != layout.MUST_BREAK:
            return None
        f = 0 if r < -0.5 else 1 if r <= 0.5 else 2 if r <= 1 else 3
        total += (10 + bad) ** 2 + 10_000 * (abs(f - fit) > 1) + 10_000 * (flagged and items[b][5])
        if items[b][4] != layout.MUST_BREAK:
            total += items[b][4] ** 2
        fit, flagged, start = f, items[b][5], b + 1
        while start < len(items) and items[start][0] != layout.BOX and items[start][4] != layout.MUST_BREAK:
            start += 1
    return total


@given(st.lists(st.integers(3, 14), min_size=2, max_size=8), st.integers(18, 39), st.lists(st.booleans(), min_size=8, max_size=8))
@settings(max_examples=60, deadline=None)
def test_line_breaking_is_optimal(widths, width, hyphens):
    items = []
    for i, x in enumerate(widths):
        if i:
            items += [layout.glue(4, 2, 1)]
        items += [layout.box(x)] + [layout.penalty(50, 2, True), layout.box(3)] * hyphens[i % 8]
    items = layout.paragraph(items)
    legal = [i for i, x in enumerate(items[:-1]) if x[0] == layout.GLUE and i and items[i - 1][0] == layout.BOX or x[0] == layout.PENALTY and x[4] < layout.NO_BREAK]
    best = min((c for n in range(len(legal) + 1) for own in combinations(legal, n) if (c := cost(items, width, [*own, len(items) - 1])) is not None), default=None)
    if best is not None:
        assert layout.break_lines(items, width)[2] == pytest.approx(best)


def test_unclosed_paragraph_is_refused():
    with pytest.raises(ValueError):
        layout.break_lines([layout.box(1)], 10)


def test_columns_keep_headings_with_text():
    assert layout.plan_columns([0, 0, 0, 1, 0, 0], 4) == [0, 3]
    assert layout.plan_columns([2, 0, 0, 2, 2, 0], 3) == [1, 5]
    assert layout.plan_columns([], 3) == []


def test_text_helpers(spark):
    row = spark.range(1).select(
        tx.collapse_space(F.lit(" a   b\n")).alias("a"), tx.book_key(F.lit("1. Könige")).alias("b"), tx.lookup_word(F.lit("«Wort!»")).alias("c"), tx.lookup_word(F.lit("…")).alias("d"),
        tx.display_key(F.lit("00026"), F.lit(26)).alias("e"), tx.xml_escape(F.lit('<a & "b">')).alias("f"), tx.has_word(F.lit("Im Anfang, das Wort"), F.lit("wort")).alias("g"),
    ).first()
    assert list(row) == ["a b", "1koenige", "Wort", None, "G26", "&lt;a &amp; &quot;b&quot;&gt;", True]


def test_fold_is_the_whole_decomposition(spark):
    import unicodedata

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if ord(c) < 128).lower()
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x110000)] if unicodedata.normalize("NFKD", chr(c)) != chr(c) or c < 128]
    texts = ["x" + "".join(chars[i : i + 50]) for i in range(0, len(chars), 50)] + ["𝐀𝐁𝐂 ⑩ ㎏ ⒜ ㏒", "Plain ASCII", "Größe … ½"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.fold(F.col("t")).alias("f")).collect()
    assert [(r["t"], r["f"]) for r in rows if r["f"] != plain(r["t"])] == []


def test_marker_labels_of_any_index(spark):
    def label(i):
        out, n = "", i + 1
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
        return out

    at = [0, 25, 26, 701, 702, 475253, 475254, 12356629, 10**12]
    got = spark.createDataFrame([(i,) for i in at], "i long").select(tx.marker_label(F.col("i")).alias("m")).collect()
    assert [r["m"] for r in got] == [label(i) for i in at]


def test_forms_are_all_words_of_a_token(spark):
    words = sorted({w for t in tx.ALIASES.values() for w in tx.forms(t)} | set(tx.ALIASES) | {"hirtern", "lasten", "ab", "kiste"})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.canonical(F.col("w")).alias("t")).collect()
    assert all(r["w"] in tx.forms(r["t"]) for r in rows)


def test_built_in_names():
    names = refs.built_in()
    cases = {"Genesis 1:1": "Gen.1.1", "Psalm 23": "Ps.23", "Matthäus 5,3": "Matt.5.3", "Römer 8,1": "Rom.8.1", "1. Mose 3,1": "Gen.3.1", "Offenbarung 1,1": "Rev.1.1", "1 Kor 13,4": "1Cor.13.4", "Song of Solomon 2:1": "Song.2.1"}
    assert {t: refs.parse(t, names)[0] for t in cases} == cases
    assert len(names.at) == 294 and set(names.at.values()) == set(range(66))
    found = [f.osis() for f in refs.scan("See Song of Solomon 2:1-3.5, then 4,2; 1. Joh 3,1b and Kap. 2", names)]
    assert found == ["Song.2.1-Song.2.5", "Song.4.2", "Song.2"]


def test_scores_of_four_documents(spark):
    """Scores of a small corpus."""
    from codexloom.operators import search

    texts = ["Und die Schlange war listiger denn alle Tiere auf dem Felde.", "Der HERR ist mein Hirte, mir wird nichts mangeln.", "Ich bin der gute Hirte und kenne die Meinen.", "Am Anfang schuf Gott Himmel und Erde."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    found = lambda q: {r["doc"]: round(r["score"], 6) for r in search.scores(docs, "doc", "text", q).filter("score > 0").collect()}
    assert found("Der Herr ist mein Hirte") == {1: 4.487387, 2: 2.079442}
    assert found("Schlange") == {0: 1.094521} and found("Bäume") == found("") == {}


def test_breaks_of_a_paragraph():
    """A paragraph's widths and the items at which its lines end."""
    from codexloom.operators.layout import box, break_lines, glue, paragraph

    items = []
    for i, width in enumerate((7, 11, 5, 9, 13, 6, 8, 10, 4, 12, 9, 7, 11, 5, 8)):
        items += [glue(400, 200, 100)] * (i > 0) + [box(100 * width)]
    assert break_lines(paragraph(items), 3400)[0] == [5, 11, 17, 23, 31]


@given(st.lists(st.lists(st.sampled_from([0, 7, 14, 21, 35, 42, 56, 70, 98, 200, 410]), max_size=40), max_size=6), st.sampled_from([60, 150, 400]), st.sampled_from([1, 25, 1 << 16]))
@settings(max_examples=150, deadline=None)
def test_words_break_as_items_do(texts, width, step):
    import numpy as np

    kept, layout.STEP_WORDS = layout.STEP_WORDS, step
    try:
        found = layout.break_words([np.array(t, np.int64) for t in texts], np.full(len(texts), width * 100))
    finally:
        layout.STEP_WORDS = kept
    assert found == [layout.break_lines(layout._words(t), width * 100)[0] for t in texts]


def test_lines_of_all_texts_are_rated_together(monkeypatch):
    import numpy as np

    monkeypatch.setattr(layout, "break_lines", None)  # no text of common words is broken by itself
    rng = np.random.default_rng(1)
    texts = [7 * rng.integers(1, 12, n) for n in (1, 30, 400)]
    assert [len(x) > 0 and x[-1] == 2 * len(t) + 1 for x, t in zip(layout.break_words(texts, np.full(3, 40_000)), texts, strict=True)] == [True] * 3
