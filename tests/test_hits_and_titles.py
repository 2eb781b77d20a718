"""Nearest marks against all pairs, books in titles against a search word by word."""

import random
import re

from codexloom.functions import references as refs
from codexloom.operators import hits, titles


def test_nearest_marks(spark):
    rng = random.Random(2)
    marks = [(k, m, rng.uniform(0, 900), rng.uniform(0, 900), rng.choice([0.0, 4.0, 9.0, 40.0, 400.0]), rng.choice([0.0, 6.0, 30.0])) for k in range(4) for m in range(40)] + [(9, 1, 10.0, 10.0, 4.0, 4.0), (9, 2, 10.0, 10.0, 4.0, 4.0), (None, 3, 0.0, 0.0, 1.0, 1.0)]
    spots = [(k, i, rng.uniform(-50, 1000), rng.uniform(-50, 1000)) for k in range(4) for i in range(80)] + [(9, 0, 12.0, 12.0), (9, 1, -12.0, 12.0), (9, 2, -12.1, 12.0), (8, 0, 1.0, 1.0), (9, 3, None, 2.0)]
    want = {}
    for k, i, x, y in spots:
        near = []
        for j, m, left, top, w, h in marks:
            px, py = max(22.0, 1.5 * w), max(22.0, 1.5 * h)
            if j == k and x is not None and left - px <= x <= left + w + px and top - py <= y <= top + h + py:
                near.append((abs(x - left - w / 2) + abs(y - top - h / 2), m))
        want[k, i] = min(near)[1] if near else None
    got = hits.nearest_marks(spark.createDataFrame(spots, "k int, at int, x double, y double"), spark.createDataFrame(marks, "k int, mark int, left double, top double, width double, height double"), ["k"]).collect()
    assert {(r.k, r.at): r.mark for r in got} == want and len(got) == len(want)
    assert sum(m is not None for m in want.values()) > 50


def test_book_in_title(spark):
    names = refs.built_in().at
    texts = ["Kommentar zum Römerbrief", "Der 1. Korinther-Brief", "Das Johannesevangelium", "Auslegung: 1 Mose und Mose", "Nichts davon", "", None, "Song of Solomon", "Ein Song of Solomon", "die Briefe", "Hiob/Hiobbuch", "1. Könige 2. Könige"]

    def book(text):
        words = re.findall(r"[\w.]+", (text or "").replace("_", " "))
        for i in range(len(words)):
            for n in (3, 2, 1):
                if i + n <= len(words):
                    whole = " ".join(words[i : i + n])
                    for form in [whole, *(whole[: -len(s)].rstrip("-") for s in titles.SUFFIXES if whole.endswith(s))]:
                        if refs.book_key(form) in names:
                            return names[refs.book_key(form)]
        return None

    df = spark.createDataFrame(list(enumerate(texts)), "id int, title string")
    got = {r.id: r.book for r in titles.book_in_title(df, ["id"], "title", titles.name_table(spark, names)).collect()}
    assert got == {i: book(t) for i, t in enumerate(texts)}
    assert got[0] == refs.SHORT.index("Rö") and got[2] == refs.SHORT.index("Joh") and got[4] is None
