import random
import re
from collections import defaultdict

import numpy as np
import pytest

from codexloom.llm import ngram_join as op
from codexloom.llm.components import components


def brute(rows):
    """class and number of links by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    linked = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                linked[i].add(j)
                linked[j].add(i)
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, own in linked.items():
            low = min([root[i], *(root[j] for j in own)], key=lambda k: rows[k][0])
            if rows[low][0] < rows[root[i]][0]:
                root[i], changed = low, True
    return {r[0]: (rows[root[i]][0], len(linked[i])) for i, r in enumerate(rows)}


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, base = [], [[word() for _ in range(n)] for n in (3, 12, 40, 200, 2000)]
    for words in base:
        for _ in range(14):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += ["", None, "  \n", "one", "one", "x y", *(" ".join(word() for _ in range(60)) for _ in range(20))]
    rng.shuffle(rows)
    return [(3 * i + 7, t) for i, t in enumerate(rows)]


def test_equals_brute_force(spark):
    rows = corpus()
    got = op.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'z' as sig")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(rows)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(op, "BAND_BLOCK", 3)
    monkeypatch.setattr(op, "CLUSTER_BLOCK", 2)
    rows = corpus()
    got = op.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(rows)


def test_null_ids_and_empty_table(spark):
    text = " ".join(map(str, range(30)))
    got = op.similarity_classes(spark.createDataFrame([(None, text), (1, text), (2, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in got) == [(0, 0), (1, 1), (2, 1), (2, 1)]
    assert op.similarity_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("part_edges", [5, 1_000_000])
def test_components(spark, part_edges):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(7), part_edges=part_edges)
    assert {r["node"]: r["root"] for r in got.collect()} == root


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (4000, op.VALUES)).astype(np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    sig, size, i = np.concatenate([a, b]), np.full(8000, 100), np.arange(4000)
    assert len(op.survivors(sig, size, i, i + 4000)) >= 3995
    assert len(op.survivors(sig, size, i, np.roll(i, 1) + 4000)) == 0
