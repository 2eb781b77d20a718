"""Carried state, composed automata, doubled chains, and verses against sequential folds."""

import random

import pytest
from pyspark.sql import functions as F

from codexloom.operators import ordered, verses


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_carried(spark, size):
    rng = random.Random(size)
    rows = [(k, i, rng.choice([None, 1, 2, 3])) for k in range(3) for i in sorted(rng.sample(range(500), 60))] + [(None, 1, 1), (9, 0, None)]
    df = spark.createDataFrame(rows, "k int, i int, v int").withColumn("other", F.lit("x")).repartition(5)
    got = ordered.carried(df, ["k"], ["i"], F.expr(f"i div {size}"), lag={"g": F.col("v")}, last={"l": F.col("v")}, total={"t": F.col("v")}).collect()
    want, state = {}, {}
    for k, i, v in sorted((r for r in rows if r[0] is not None), key=lambda r: r[:2]):
        g, last, t = state.get(k, (None, None, 0))
        want[k, i] = (v, "x", g, last, t)
        state[k] = (v, last if v is None else v, t + (v or 0))
    assert {(r.k, r.i): (r.v, r.other, r.g, r.l, r.t) for r in got} == want and len(got) == len(want)
    assert ordered.carried(df.limit(0), ["k"], ["i"], F.lit(0), lag={"g": F.col("v")}).collect() == []


@pytest.mark.parametrize("size", [2, 7, 512])
def test_states(spark, size):
    rng = random.Random(4)
    codes = ["0123", "1111", "3210", "2222", "0022", "1230"]
    rows = [(k, i, rng.choice(codes)) for k, n in ((1, 0), (2, 1), (3, 300), (4, 90)) for i in range(n)] + [(None, 0, "0000")]
    df = spark.createDataFrame(rows, "k int, i int, c string").repartition(4)
    got = ordered.states(df, ["k"], "i", F.col("c"), "s", start=2, size=size).collect()
    want, state = {}, {}
    for k, i, c in rows:
        if k is not None:
            want[k, i] = (c, state.get(k, 2))
            state[k] = int(c[state.get(k, 2)])
    assert {(r.k, r.i): (r.c, r.s) for r in got} == want and len(got) == len(want)


def test_chain(spark):
    rng = random.Random(6)
    rows = [(k, i, i + rng.choice([1, 1, 2, 5])) for k, n in ((1, 1), (2, 40), (3, 2)) for i in range(n)]
    ends = {1: 1, 2: 40, 3: 2}
    rows = [(k, i, f if f < ends[k] else None) for k, i, f in rows]
    got = {tuple(r) for r in ordered.chain(spark.createDataFrame(rows, "k int, i int, f int"), ["k"], "i", "f").collect()}
    to, want = {(k, i): f for k, i, f in rows}, set()
    for k in ends:
        at = 0
        while at is not None:
            want.add((k, at))
            at = to[k, at]
    assert got == want


def folded(events):
    """The same rules, one event after another."""
    out, titles = [], []
    book = chapter = None
    verse, held, waiting, block, begun = 0, [], [], None, False

    def settle():
        if held and out:
            out[-1][4] += held
        held.clear()

    for pos, kind, b, c, number, text in events:
        text = text.strip()
        if pos != block:
            block, begun = pos, False
        if kind == "start":
            settle()
            book, chapter, verse = b, c, 0
            waiting.clear()
            continue
        if not chapter:
            continue
        if kind == "title":
            waiting.append(text)
            continue
        digits = len(text) - len(text.lstrip("0123456789"))
        if number is None and verse == 0 and 0 < digits <= 3 and text[digits:].startswith(" "):
            number, text = int(text[:digits]), text[digits:].lstrip()
            number = 1 if number == chapter else number
        if number is None:
            if not text:
                continue
            begun = True
            if held and (verse == 0 or held[-1][-1] not in '.!?:;«»"' or text[0].islower()):
                held.append(text)
            else:
                settle()
                held.append(text)
            continue
        number = max(1, number)
        if verse > 0 and number == 1:
            settle()
            chapter, verse = chapter + 1, 0
        elif verse >= 2 and number < verse and number <= 3 and held:
            chapter, verse = chapter + 1, 0
        elif not (verse == 0 and number >= 2 and held):
            settle()
        if verse == 0 and number >= 2 and held:
            out.append([book, chapter, 1, True, list(held)])
            titles += [(len(out), t) for t in waiting]
            waiting.clear()
            held.clear()
        verse = number
        out.append([book, chapter, number, not begun, [text] if text else []])
        begun = True
        titles += [(len(out), t) for t in waiting]
        waiting.clear()
    settle()
    return [(b, c, v, p, " ".join(" ".join(t).split())) for b, c, v, p, t in out], titles


def random_parts(rng):
    rows = []
    for pos in range(rng.randint(0, 120)):
        kind = rng.choice(["text"] * 8 + ["start", "title"])
        if kind == "start":
            rows.append((pos, 0, kind, rng.randint(1, 3), rng.choice([0, 1, 1, 4]), None, "Chapter"))
        elif kind == "title":
            rows.append((pos, 0, kind, None, None, None, f"T {pos}"))
        else:
            for part in range(rng.randint(1, 4)):
                number = None if part == 0 and rng.random() < 0.6 else rng.choice([1, 2, 2, 3, 4, 5, 30])
                rows.append((pos, part, kind, None, None, number, rng.choice(["", " ", "Und es.", "und", "Er sprach", "1 Am Anfang", "4 Vier.", "2 Zwei", "a  b", "Satz!"])))
    return rows


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_verses_equal_the_fold(spark, size):
    rng = random.Random(11)
    docs = {d: random_parts(rng) for d in range(60)}
    kinds = "doc_id int, pos long, part int, kind string, book int, chapter int, number int, text string, verse string"
    df = spark.createDataFrame([(d, *r, "clash") for d, rows in docs.items() for r in rows] + [(None, 0, 0, "start", 1, 1, None, "", "")], kinds).repartition(7)
    found, titles = verses.verses(df, size)
    own, over = {d: [] for d in docs}, {d: [] for d in docs}
    order = {}
    for r in sorted(found.collect(), key=lambda r: r.ordinal):
        own[r.doc_id].append((r.book, r.chapter, r.verse, r.paragraph, r.text))
        order[r.doc_id, r.ordinal] = len(own[r.doc_id])
    for r in sorted(titles.collect(), key=lambda r: (r.ordinal, r.seq)):
        over[r.doc_id].append((order[r.doc_id, r.ordinal], r.text))
    for d, rows in docs.items():
        want = folded([(p, *rest) for p, _, *rest in rows])
        assert own[d] == want[0] and over[d] == want[1], d


def test_parts_of(spark):
    kind = "doc_id int, pos long, kind string, book int, chapter int, text string, marks array<struct<at int, number int>>"
    rows = [(1, 0, "heading", 2, 3, "Kapitel 3", None), (1, 1, "paragraph", None, None, "abcdef", [(0, 1), (2, 2), (2, 3)]), (1, 2, "paragraph", None, None, "x", None), (1, 3, "heading", None, None, "T", []), (1, 4, "paragraph", 9, 9, None, [])]
    got = sorted((r.pos, r.part, r.kind, r.book, r.chapter, r.number, r.text) for r in verses.parts_of(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, 0, "start", 2, 3, None, "Kapitel 3"), (1, 0, "text", None, None, None, ""), (1, 1, "text", None, None, 1, "ab"), (1, 2, "text", None, None, 2, ""), (1, 3, "text", None, None, 3, "cdef"), (2, 0, "text", None, None, None, "x"), (3, 0, "title", None, None, None, "T"), (4, 0, "text", None, None, None, None)]


@pytest.mark.parametrize("size, joins", [(100, False), (4, True)])
def test_only_keys_of_several_chunks_are_joined(spark, size, joins):
    rows = [("a", i, i % 3) for i in range(3)] + [("b", i, None if i % 4 else i) for i in range(11)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    found = ordered.carried(df, ["k"], ["i"], F.expr(f"i div {size}"), {"g": F.col("v")}, {"l": F.col("v")}, {"t": F.col("v")})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == joins
    expected = []
    for k in "ab":
        own = [v for x, _, v in rows if x == k]
        for i, v in enumerate(own):
            past = [x for x in own[:i] if x is not None]
            expected.append((k, i, v, own[i - 1] if i else None, past[-1] if past else None, sum(past)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_moves_give_the_rows_back(spark):
    df = spark.createDataFrame([("a", i, "10" if i % 3 else "01") for i in range(9)], "k string, i int, c string")
    got = sorted(map(tuple, ordered.moves(df, ["k"], "i", "c", "s", 0, 2).select("k", "i", "c", "s").collect()))
    state, expected = 0, []
    for i in range(9):
        c = "10" if i % 3 else "01"
        expected.append(("a", i, c, state))
        state = int(c[state])
    assert got == expected
