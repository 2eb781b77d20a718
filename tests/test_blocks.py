"""Block building against a builder that reads one line after another."""

import random
import re

import pytest

from codexloom.operators import blocks

LINE = "doc_id int, pos long, page int, top double, left double, right double, size double, bold boolean, italic boolean, cells array<struct<left: double, text: string>>, kind string, text int"
PROFILE = "doc_id int, body_size double, body_pitch double, body_left double, body_right double"
P = {"size": 10.0, "pitch": 12.0, "left": 50.0, "right": 350.0}
MARK = re.compile(r"^\s*(?:[0-9]{1,2}[.)] (?=.)|[•–-] (?=.)|[a-z][.)] )")


def random_lines(rng):
    top, page, out = 0.0, 0, []
    for pos in range(rng.randint(0, 90)):
        if rng.random() < 0.05:
            page, top = page + rng.choice([1, 1, 2]), 0.0
        top += rng.choice([12.0] * 6 + [20.0])
        left = rng.choice([50.0] * 6 + [57.0, 60.0, 62.0, 70.0, 95.0])
        right = rng.choice([350.0] * 5 + [348.0, 240.0, 200.0, 100.0])
        size = rng.choice([10.0] * 9 + [10.6, 12.0, 14.0, 9.0])
        text = rng.choice(["und so weiter", "Der Satz", "geht wei-", "Teil-­".replace("-", ""), "5", "17", "1. Punkt", "2. Punkt", "3) x", "• eins", "- zwei", "a) drei", "so:", "12 Vers", "A-", "2. Mose", "ein Satz über vier Worte hinaus"])
        cells = [(left, text)]
        if rng.random() < 0.15:
            cells += [(left + 100.0 + rng.choice([0, 3, 40]), rng.choice(["b", "c d", "e f g h i"]))] + ([(left + 220.0, "z")] if rng.random() < 0.3 else [])
        if rng.random() < 0.1:
            cells = [(left + 100.0, text)]
            left += 100.0
        out.append((pos, page, top, left, right, size, rng.random() < 0.15, rng.random() < 0.1, cells))
    return out


def build(lines):
    """kind, style, level, list, text of blocks by first line, and table lines by the table's first line."""
    out, tables, heads = [], [], []
    para, first, margin, quote, style, listing, table, prev = [], None, None, False, "body", None, [], None
    edge = P["right"] - 0.25 * (P["right"] - P["left"])

    def close():
        nonlocal para
        if para:
            text = para[0][1]
            for (_, a, _), (_, b, _) in zip(para, para[1:], strict=False):
                text = text.rstrip()
                if text.endswith("­"):
                    text = text[:-1] + b
                elif text.endswith("-") and len(a.rstrip()) > 1:
                    text = (text[:-1].rstrip() if b[:1].islower() else text) + b
                else:
                    text += " " + b
            text = " ".join(text.split())
            if text:
                single = len(para) == 1 and para[0][2] and style[0] == "body" and style[1] is None
                out.append([para[0][0], "item" if style[2] else "paragraph", style[0], None, style[1], text, single])
        para = []

    def end_table():
        nonlocal table, para, style, first, margin, quote, listing
        if len(table) == 1:
            pos, text, short, left = table[0]
            para, style, first, margin, quote = [(pos, text, short)], ("body", None, False), left, left, False
        elif table:
            out.append([table[0][0], "table", None, None, None, None, False])
            tables.append([t[0] for t in table])
        table = []

    columns = []
    for pos, page, top, left, right, size, bold, italic, cells in lines:
        text = " ".join(t for _, t in cells)
        gap = float("inf")
        if prev and prev["page"] == page:
            gap = top - prev["top"]
        elif prev and prev["right"] >= edge:
            gap = P["pitch"]
        digits = re.fullmatch("[0-9]*", text.strip()) is not None
        spread = len(cells) >= 2 and not table and bool(para) and right >= P["right"] - P["size"] and abs(size - P["size"]) < 0.3 and all(len(t.split()) <= 4 for _, t in cells)
        single = len(cells) == 1 or spread
        this = {"page": page, "top": top, "right": right, "size": size, "bold": bold, "text": text}
        if not single or (len(cells) == 1 and table and any(abs(c - left) < 6 for c in columns) and gap < 1.45 * P["pitch"]):
            if not table:
                close()
                listing = None
            if not single:
                columns = [c for c, _ in cells[1:]]
            table.append((pos, text, right < edge, left))
            prev = this
            continue
        end_table()
        short, larger = right - left < 0.85 * (P["right"] - P["left"]), size > P["size"] + 0.4
        if (larger and (short or digits)) or (size > 1.3 * P["size"] and not digits) or (bold and short and not digits and not para and len(cells) == 1):
            close()
            listing = None
            if heads and heads[-1][0][-1] == pos - 1 and heads[-1][1] == round(size * 10):
                heads[-1][0].append(pos)
                heads[-1][2].append(text)
            else:
                heads.append(([pos], round(size * 10), [text]))
            prev = this
            continue
        indented, far = left > P["left"] + 6, gap > 1.45 * P["pitch"]
        after_short, colon = prev is not None and prev["right"] < edge, prev is not None and prev["text"].rstrip().endswith(":")
        mark, number = MARK.match(text) is not None, int(m[1]) if (m := re.match(r"\s*([0-9]{1,2})[.)] ", text)) else None
        follows = listing is not None and listing[1] and number == listing[2] + 1
        starts = mark and (not para or far or after_short or indented or colon or (listing is not None and abs(left - first) < 1 and left < margin) or follows)
        restyled = prev is not None and ((prev["bold"] != bold and not italic) or abs(prev["size"] - size) > 0.4)
        indent = indented and listing is None and not quote and left < P["left"] + 30 and bool(para) and left > margin + 6
        hyphen = bool(para) and para[-1][0] == pos - 1 and re.search("(­|.-)$", para[-1][1].rstrip()) is not None
        if not para or (not hyphen and (far or starts or restyled or after_short or indent)):
            close()
            scripture = bold and re.match(r"\s*[0-9]{1,3}\s", text) is not None
            quote = not scripture and indented and not starts and listing is None and left > P["left"] + 30
            if starts:
                if listing is not None and (follows if listing[1] else number is None):
                    listing = (listing[0], listing[1], listing[2] + 1)
                else:
                    listing = (pos, number is not None, 1)
                text = text[MARK.match(text).end() :]
            elif listing is not None and not indented:
                listing = None
            style = ("scripture" if scripture else "quote" if quote else "body", listing and listing[0], starts)
            first = margin = left
        elif left > first + 0.5:
            margin = left
        para.append((pos, text, right < edge))
        prev = this
    end_table()
    close()
    sizes = sorted({s for _, s, _ in heads}, reverse=True)
    out += [[p[0], "heading", None, min(6, sizes.index(s) + 1), None, " ".join(" ".join(t).split()), False] for p, s, t in heads]
    out.sort(key=lambda b: b[0])
    for i, b in enumerate(out):
        if b[6] and (i and out[i - 1][6] or i + 1 < len(out) and out[i + 1][6]):
            b[2] = "poetry"
    return [tuple(b[:6]) for b in out], tables


@pytest.mark.parametrize("size", [3, 4096])
def test_blocks_equal_the_builder(spark, size):
    rng = random.Random(21)
    docs = {d: random_lines(rng) for d in range(60)}
    rows = [(d, *line, "clash", 0) for d, lines in docs.items() for line in lines] + [(None, 0, 0, 0.0, 0.0, 0.0, 0.0, False, False, None, "x", 0)]
    lines = spark.createDataFrame(rows, LINE).repartition(6)
    profile = spark.createDataFrame([(d, *P.values()) for d in docs], PROFILE)
    got = {d: [] for d in docs}
    for r in sorted(blocks.blocks(lines, profile, size).collect(), key=lambda r: r.pos):
        got[r.doc_id].append((r.pos, r.kind, r.style, r.level, r.list, r.text))
    cells = blocks.tables(lines, profile, size).collect()
    for d, own in docs.items():
        want, tables = build(own)
        assert got[d] == want, d
        assert sorted({r.pos for r in cells if r.doc_id == d}) == [t[0] for t in tables]


def test_tables(spark):
    grid = [[(50.0, "a"), (150.0, "b")], [(52.0, "c"), (154.0, "d"), (250.0, "e")], [(151.0, "wraps")], [(50.0, "f"), (250.0, None)]]
    rows = [(1, i, 0, 12.0 * i, c[0][0], 200.0, 10.0, None, None, c, None, None) for i, c in enumerate(grid)] + [(2, 0, 0, None, None, None, None, None, None, None, None, None)]
    profile = spark.createDataFrame([(d, *P.values()) for d in (1, 2)], PROFILE)
    lines = spark.createDataFrame(rows, LINE)
    got = sorted((r.pos, r.row, r.col, r.text) for r in blocks.tables(lines, profile).collect())
    assert got == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "c"), (0, 1, 1, "d wraps"), (0, 1, 2, "e"), (0, 2, 0, "f"), (0, 2, 2, "")]
    assert [(r.doc_id, r.kind) for r in blocks.blocks(lines, profile).collect()] == [(1, "table")]
    assert blocks.blocks(lines.limit(0), profile).collect() == []
