"""Lines from fragments against a page reader that goes fragment by fragment."""

import random
import re

from codexloom.operators import lines

KIND = "doc_id int, page int, x double, y double, rise double, width double, size double, bold boolean, italic boolean, text string"


def page_of(rng):
    out, y = [], 100.0
    for _ in range(rng.randint(0, 12)):
        y += rng.choice([0.9, 1.3, 2.5, 12.0, 12.0, 14.0])
        x = rng.choice([50.0, 60.0])
        tracked = rng.random() < 0.3
        for _ in range(rng.choice([1, 3, 6, 14])):
            kind = rng.random()
            text, size, dy = rng.choice(["Wort", "wo", "und ", "ab-", ",", ").", "(", "e", "Teil­", "aﬂ", " iegen", "x­y"]), rng.choice([10.0, 10.0, 10.0, 12.0]), 0.0
            if kind < 0.15:
                text, size, dy = rng.choice(["1", "12,", "a", "*", "b)"]), 6.0, rng.choice([3.0, 4.5])
            width = 5.0 * len(text)
            out.append((x, round(y - dy + rng.choice([0, 0, 0.4, 0.8]), 2), rng.choice([0.0, 0.0, 0.0, dy]), width, size, rng.random() < 0.2, rng.random() < 0.2, text))
            x = round(x + width + (rng.choice([0.5, 0.6]) if tracked else rng.choice([0.0, 0.0, -1.0, 1.0, 2.0, 4.0, 9.0])), 2)
    return out


def read(fragments):
    q = lambda f: round(100 * (f[1] + f[2]))
    rows = sorted(fragments, key=lambda f: (q(f), f[0], f[7], f[3], f[4], f[5], f[6]))
    groups = []
    for f in rows:
        if groups and q(f) - q(groups[-1][0]) <= 150:
            groups[-1].append(f)
        else:
            groups.append([f])
    made, i = [[(f, f[2]) for f in g] for g in groups], 0
    base = [q(g[0]) for g in groups]
    while i + 1 < len(made):
        marks = all(re.fullmatch(r"[0-9*)]+|[a-z]", re.sub(r"[,.;:)]+$", "", f[7].strip())) for f, _ in made[i])
        size, below = (max(f[4] for f, _ in g) for g in made[i : i + 2])
        lift = (base[i + 1] - base[i]) / 100
        if marks and size < 0.8 * below and 0 < lift < 0.7 * below:
            moved = made.pop(i)
            made[i] += [(f, r + lift) for f, r in moved]
            base.pop(i)
        else:
            i += 1
    out, order = [], {id(f): i for i, f in enumerate(rows)}
    for group, top in zip(made, base, strict=True):
        group.sort(key=lambda p: (p[0][0], order[id(p[0])]))
        count = {}
        for f, r in group:
            if abs(r) <= 0.5:
                style = (round(f[4] * 10), f[5], f[6])
                count[style] = count.get(style, 0) + len(f[7])
        style = max(count, key=lambda s: (count[s], s)) if count else (round(group[0][0][4] * 10), *group[0][0][5:7])
        size = style[0] / 10
        space, widths = size * 0.25, []
        for i, (f, _) in enumerate(group):
            after = group[i + 1][0][0] if i + 1 < len(group) else None
            widths.append(after - f[0] if after is not None and after > f[0] and f[0] + f[3] > after + 0.05 else f[3])
        gaps = sorted(g for i in range(len(group) - 1) if group[i][0][7].strip() and not group[i + 1][0][7].startswith(" ") and (g := round(group[i + 1][0][0] - group[i][0][0] - widths[i], 4)) > 0)
        tracking = gaps[len(gaps) // 2] if len(gaps) >= 8 and 2 * len(gaps) >= len(group) and gaps[len(gaps) // 2] < space else 0
        cells, marks, end, before = [[group[0][0][0], "", 0]], [], None, ""
        for i, (f, rise) in enumerate(group):
            text, t = f[7], f[7].strip()
            lone = t != "" and all(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~–»«’" for c in t) and t[0] not in "(»„["
            if end is not None and not lone:
                gap = round(f[0] - end, 4)
                if gap > 2.5 * space:
                    cells.append([f[0], "", 0])
                elif gap > 0.6 * space + tracking:
                    cells[-1][1] += " "
            if (rise > 0.5 or f[4] < 0.8 * size and (f[6] and re.fullmatch("[a-z]", t) or round(100 * (f[1] + f[2])) < top - 50)) and (m := re.fullmatch(r"([0-9]+|[a-z])[,.;:)]*", t)):
                marks.append(m[1])
            text = text.rstrip().replace("­", "") + "­" * text.rstrip().endswith("­") if i + 1 == len(group) else text.replace("­", "")
            if before.rstrip().endswith("ﬂ") and re.match("^ +[a-z]", text):
                text = text.lstrip()
            end, before = f[0] + widths[i], f[7]
            cells[-1][1] += text.replace("ﬂ", "fl")
            cells[-1][2] = end
        cells = [(left, " ".join(t.split()), e) for left, t, e in cells if t.strip()]
        if cells:
            out.append((top / 100, cells[0][0], round(cells[-1][2], 6), size, style[1], style[2], [c[:2] for c in cells], marks))
    return out


def test_lines(spark):
    rng = random.Random(17)
    pages = {(d, p): page_of(rng) for d in range(8) for p in range(6)}
    rows = [(d, p, *f) for (d, p), own in pages.items() for f in own] + [(None, 1, 0.0, 0.0, 0.0, 0.0, 1.0, False, False, "x"), (1, None, 0.0, 0.0, 0.0, 0.0, 1.0, False, False, "x"), (1, 1, 0.0, 0.0, 0.0, 0.0, 1.0, None, None, None)]
    rng.shuffle(rows)
    got = {k: [] for k in pages}
    for r in sorted(lines.lines(spark.createDataFrame(rows, KIND).repartition(5)).collect(), key=lambda r: r.line):
        assert r.line == len(got[r.doc_id, r.page]) and r.text == "\t".join(c.text for c in r.cells)
        got[r.doc_id, r.page].append((r.top, r.left, round(r.right, 6), r.size, r.bold, r.italic, [tuple(c) for c in r.cells], list(r.marks)))
    for k, own in pages.items():
        assert got[k] == read(own), k


def test_no_fragments(spark):
    assert lines.lines(spark.createDataFrame([], KIND)).collect() == []
