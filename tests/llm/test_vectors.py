"""Divergence audit, whitening and metric join against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexloom.llm import divergence, metric_join, whitening

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<float>, label int"
CLASH = {"n": 1, "component": "x", "n_links": "y", "space": 0, "node": 0, "size": 0, "key": 0, "term": "t", "count": 0, "value": 0, "rank": 0, "total": 0}


def audited(rows):
    docs = [((lang or ""), (source or ""), Counter(t.translate(ASCII_LOWER) for t in TERM.findall(text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in of for t in d[2]).items() if n >= 3)
        counts = defaultdict(Counter)
        for _, source, c in of:
            counts[source].update(c)
        whole = sum(counts.values(), Counter())

        def share(c):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(pairs, 1)} | {(lang, s, "term", t, v, i) for i, (v, t) in enumerate(terms[:200], 1)}
    return out


def texts_of(rng):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "é", "ß", "日本", "\U0001f600", "Über", "AbC", "abc"]
    text = lambda: rng.choice(["  ", "1", ", ", "\x00", "[_`{"]).join(rng.choice(words, rng.integers(0, 80)))
    rows = [(text(), rng.choice(["en", "de", None]), f"s{min(i % 9, 4)}") for i in range(120)]
    return [*rows, rows[0], rows[0], (None, "en", "empty"), ("", None, None), ("é" * 5000 + " abc" * 20000, "de", "long"), ("only once", "fr", "a"), ("1 2 3", "fr", "b"), ("x", "it", "one"), ("É" * 40, "en", "s日"), *[("tie tie", "ties", f"t{i}") for i in range(4)]]


@pytest.mark.parametrize(("terms", "sources"), [(1024, 256), (16, 2), (7, 4)])
def test_audit(spark, terms, sources):
    rows = texts_of(np.random.default_rng(4))
    docs = spark.createDataFrame([(t, None if x is None else str(x), s) for t, x, s in rows], "text string, lang string, source string").withColumns({c: F.lit(v) for c, v in CLASH.items()})
    got = divergence.audit(docs.repartition(4), terms, sources).collect()
    assert {tuple(r) for r in got} == audited(rows)
    assert len(got) == len({tuple(r) for r in got})


def test_audit_steps_and_empty(spark, monkeypatch):
    rows = texts_of(np.random.default_rng(5))[:60]
    docs = spark.createDataFrame([(t, str(x), s) for t, x, s in rows], "text string, lang string, source string").coalesce(1)
    assert divergence.audit(docs.limit(0)).collect() == []
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"text": t, "lang": str(x), "source": s} for t, x, s in rows])
    whole = Counter()
    monkeypatch.setattr(divergence, "STEP", 700)
    for part in divergence._counted(iter([batch.slice(0, 20), batch.slice(20, 0), batch.slice(20)])):
        for r in part.to_pylist():
            whole.update({(r["lang"], r["source"], r["term"], "n"): r["count"], (r["lang"], r["source"], r["term"], "d"): r["docs"]})
    want = Counter()
    for t, x, s in rows:
        for term, n in Counter(w.translate(ASCII_LOWER) for w in TERM.findall(t)).items():
            want.update({(str(x), s, term, "n"): n, (str(x), s, term, "d"): 1})
    assert whole == want


def test_shares_of_large_counts():
    count, whole = np.array([0, 5, 4 * 10**15, 8 * 10**15 - 2]), np.array([7, 6, 8 * 10**15, 8 * 10**15])
    assert divergence.shares(count, whole).tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(count.tolist(), whole.tolist(), strict=True)]


def grid_of(x):
    return np.floor(256 * np.asarray(x, float)).astype(np.int64)


def vectors_frame(spark, rows, kind=VECTORS):
    return spark.createDataFrame(rows, kind).withColumns({c: F.lit(v) for c, v in CLASH.items()})


def test_whitening(spark):
    rng = np.random.default_rng(2)
    good = (rng.normal(size=(700, 12)) @ np.diag(np.linspace(0.1, 3, 12)) + 40).astype(np.float32)
    rows = [(i, v.tolist(), None) for i, v in enumerate(good)] + [(0, good[0].tolist(), 1), (None, good[1].tolist(), 1)]
    bad = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 12, 1), (903, [float("inf"), *[0.0] * 11], 1), (904, [None, *[0.0] * 11], 1), (905, [1.0, 2.0], 1)]
    frame = vectors_frame(spark, rows + bad).repartition(9)
    model = whitening.fit(frame)
    got = whitening.whiten(frame, model).collect()
    x = grid_of(good)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    a = fit - total / n
    values, axes = np.linalg.eigh(a.T @ a / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in got) == sorted((-1 if i is None else i, c) for i, _, _ in rows for c in (1, 2, 3, 4))
    sign = {}
    for r in got:
        own = x[1 if r.vec_id is None else r.vec_id]
        want = (own - total / n) @ axes[:, r.component - 1] / np.sqrt(values[r.component - 1])
        sign.setdefault(r.component, np.sign(r.whitened * want))
        assert r.whitened == pytest.approx(sign[r.component] * want, abs=1e-9)
        assert (r.n, r.deviation) == (n, int(((n * own - total) ** 2).sum()))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10) and r.identity_error < 1e-9


def test_whitening_degenerate(spark):
    none = vectors_frame(spark, [])
    assert whitening.whiten(none, whitening.fit(none)).collect() == []
    same = vectors_frame(spark, [(i, [1.0, 2.0], 1) for i in range(5)])
    assert whitening.whiten(same, whitening.fit(same)).collect() == []
    line = vectors_frame(spark, [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(5)])
    rows = whitening.whiten(line, whitening.fit(line)).collect()
    assert {r.component for r in rows} == {1} and all(r.explained == pytest.approx(1) for r in rows)
    large = spark.createDataFrame([(i, [3e30 * i, 1.0 * i * i]) for i in range(-2, 3)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(large, whitening.fit(large)).collect() if r.vec_id} == {None}


def test_deviation_at_the_bound():
    m = whitening.Whitening(3, 1, np.array([0]), np.array([1]), np.ones(1), np.ones((1, 1)), np.ones(1))
    for x in (0, -7, 1_012_333_332, 1_012_333_333, 1_012_333_450, 1_012_400_000):
        exact = (3 * x - 1) ** 2
        assert m.deviation(np.array([[x]])) == [exact if exact < 1 << 63 else None]


def joined(rows, threshold=0.98):
    """Brute force over all pairs."""
    usable = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    link = defaultdict(set)
    for a in usable:
        for b in usable:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.asarray(rows[i][1], float) for i in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    link[a].add(b)
                    link[b].add(a)
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            todo += (new := link[todo.pop()] - group)
            group |= new
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = (rows[j][0], len(link[j]), min(ids, default=None), rows[j][0] is not None and rows[j][0] == min(ids))
    return sorted(map(repr, out.values()))


def clustered(rng):
    centres = rng.normal(size=(6, 8))
    near = [centres[rng.integers(0, 6)] + rng.normal(size=8) * rng.choice([0.01, 0.1, 0.25]) for _ in range(260)]
    hot = [centres[0] + rng.normal(size=8) * 0.05 for _ in range(150)]
    rows = [(int(i), np.float32(v).tolist(), int(rng.integers(0, 2))) for i, v in zip(rng.permutation(410), near + hot, strict=True)]
    odd = [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [1.0, None], 1), (504, rows[0][1], None), (505, [], 1), (None, rows[0][1], rows[0][2]), (506, [1e38] * 8, 0), (507, [1e-40] * 8, 0), (508, [-0.0, 1.0], 1), (509, [0.0, 1.0], 1), (None, [5.0, 5.0], 1)]
    exact = [(600, [7.0, 1.0, 0.0], 0), (601, [7.0, 0.0, 1.0], 0), (602, [14.0, 2.0, 0.0], 0)]
    return rows + odd + exact + [(700, rows[1][1], rows[1][2])] * 5 + [(701, [2 * e for e in rows[1][1]], rows[1][2])]


@pytest.mark.parametrize(("cell", "pivots", "block"), [(1024, 16384, 4096), (20, 16384, 64), (5, 16384, 64), (20, 4, 64)])
def test_range_join(spark, cell, pivots, block):
    rows = clustered(np.random.default_rng(8))
    got = metric_join.range_join(vectors_frame(spark, rows).repartition(6), cell=cell, pivots=pivots, block=block).collect()
    assert sorted(repr(tuple(r)) for r in got) == joined(rows)


def test_range_join_other_thresholds_and_shuffled_tables(spark, monkeypatch):
    rows = clustered(np.random.default_rng(9))
    monkeypatch.setattr(metric_join, "FEW", -1)
    for threshold in (0.9, 0.999):
        got = metric_join.range_join(vectors_frame(spark, rows), threshold, cell=20, block=64).collect()
        assert sorted(repr(tuple(r)) for r in got) == joined(rows, threshold)
    assert metric_join.range_join(vectors_frame(spark, [])).collect() == []


def test_cores_are_not_compared(spark):
    """A thousand near copies meet no block of their own kind."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=32)
    base /= np.linalg.norm(base)
    rows = [(i, np.float32(base + rng.normal(size=32) * 0.005).tolist(), 1) for i in range(1000)] + [(1000 + i, np.float32(rng.normal(size=32)).tolist(), 1) for i in range(50)]
    r = metric_join.radius(0.98)
    nodes = metric_join.nodes_of(vectors_frame(spark, rows))
    table = metric_join.choose_pivots(nodes, r, 50, 1000)
    kinds = metric_join.cells(nodes, table, metric_join.reach(nodes, table), r)
    assert kinds.filter(F.col("kind") == metric_join.CORE).count() >= 1000
    assert metric_join.dealt_blocks(kinds).count() < 50 * 50
    got = metric_join.range_join(vectors_frame(spark, rows), cell=50).collect()
    assert all(x.n_links == 999 and x.component_id == 0 for x in got if x.vec_id < 1000)


def test_crowded_vectors_of_a_random_space_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(v).tolist(), 0) for i, v in enumerate(rng.normal(size=(300, 4)))]
    got = metric_join.range_join(vectors_frame(spark, rows), cell=10, block=64).collect()
    assert sorted(repr(tuple(x)) for x in got) == joined(rows)
    assert sum(x.n_links for x in got) > 0
