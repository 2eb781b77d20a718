"""Each stage against brute force on its own input, and run() against the stages."""

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"xx": ["tha", "ing", "ou", "er"], "yy": ["ung", "sch", "ei", "ach"]}


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows of documents and of each stage's result."""
    rng = random.Random(6)
    word = lambda lang: "".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(2, 5)))
    passage = {lang: " ".join(word(lang) for _ in range(70)) for lang in PARTS}
    rows = []
    for i in range(90):
        lang = rng.choice(list(PARTS))
        words = [word(lang) for _ in range(rng.randint(5, 200))]
        if i % 4 == 0:
            words[3:3] = passage[lang].split()
        rows.append((i, " ".join(words), lang, f"s{i % 3}"))
    rows += [(200 + i, rows[i][1], *rows[i][2:]) for i in range(10)]
    rows += [(300 + i, rows[40 + i][1] + " " + word(rows[40 + i][2]), *rows[40 + i][2:]) for i in range(10)]
    rows += [(400, None, "xx", "s0"), (401, "", None, None), (402, "12 34", "yy", "s1"), (403, rows[1][1], None, None), (None, rows[2][1] + " zz", rows[2][2], "s2")]
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    place = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(f"{place}/documents.parquet")
    docs, out = spark.read.parquet(f"{place}/documents.parquet"), [rows]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(place)).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append([tuple(r) for r in docs.collect()])
    out.append([tuple(r) for r in pipeline.run(spark, str(place)).collect()])
    return out


def test_language_stage_rejects_only_texts_without_language(kept):
    assert {r[0] for r in kept[0]} - {r[0] for r in kept[1]} == {400, 401, 402}
    langs = {r[0]: r[2] for r in kept[0]}
    assert all(r[2] == langs[r[0]] for r in kept[1] if langs[r[0]])


def test_join_stage_leaves_one_of_each_group(kept):
    sets = {}
    for i, text, *_ in kept[1]:
        words = WORD.findall(text)
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}
    root = {i: i for i in sets if i is not None}
    for _ in range(5):
        for a in root:
            for b in root:
                both = len(sets[a] & sets[b])
                if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    assert sorted(r[0] for r in kept[2]) == sorted(i for i in root if root[i] == i)


def test_dedup_stage_cuts_repeats(kept):
    first, expected = {}, {}
    words = {r[0]: WORD.findall(r[1]) for r in kept[2]}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        if len(gone) < len(w):
            expected[i] = [x for j, x in enumerate(w) if j not in gone]
    assert {r[0]: WORD.findall(r[1]) for r in kept[3]} == expected
    assert sum(map(len, expected.values())) < sum(map(len, words.values()))
    assert all(r[4] == len(r[1]) for r in kept[3])


def test_mixing_and_packing(kept):
    assert kept[4] and set(kept[4]) <= set(kept[3])
    assert {r[0] for r in kept[5]} == {r[0] for r in kept[4]}
    placed = defaultdict(list)
    for _, _, _, length, _, sequence, offset in kept[5]:
        placed[sequence].append((offset, length))
    assert all(sum(x for _, x in own) <= 4096 and sorted(own)[0][0] == 0 for own in placed.values())


def test_run_equals_the_stages(kept):
    assert sorted(kept[6]) == sorted(kept[5])


@pytest.mark.parametrize("most", [0, 100_000])
def test_join_stage_judges_null_and_repeated_ids_by_text(spark, monkeypatch, most):
    monkeypatch.setattr(pipeline, "MOST_REPEATED", most)
    rng = random.Random(4)
    a, b, c, d, e, f = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(6))
    rows = [(1, a), (None, a + " zz"), (None, b), (None, b), (None, b + " zz"), (7, c), (7, c), (7, d), (7, a), (9, c + " zz"), (10, d), (11, e), (None, f), (None, None), (None, None), (12, None), (12, None), (12, ""), (13, "")]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SHAPE).repartition(4)
    got = [(r["doc_id"], r["text"]) for r in pipeline.ngram_join(spark, df, "").collect()]
    # of the texts of doc_id 7 the least keeps the id's place; the others come after all doc_ids
    lead = min(a, c, d)
    expected = [(1, a), (None, b), (11, e), (None, f), (None, None), (12, None), (12, ""), (13, "")]
    expected += [(7, c) if lead == c else (9, c + " zz"), (7, d) if lead == d else (10, d)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    plain = df.filter("doc_id in (1, 9, 10, 11)")
    assert sorted(r["doc_id"] for r in pipeline.ngram_join(spark, plain, "").collect()) == [1, 9, 10, 11]
    assert pipeline.ngram_join(spark, df.limit(0), "").count() == 0
