"""Column chunking against one that walks the lines."""

import random

import pytest

from codexloom.operators import layout


def orphaned(kinds, s, e, kept):
    content = 0
    for i in range(e - 1, s, -1):
        if kinds[i] == 1:
            while i > s and kinds[i - 1] == 1:
                i -= 1
            return i > s
        content += kinds[i] == 0
        if content >= kept:
            return False
    return False


def column_end(kinds, s, n, kept):
    e = min(s + n, len(kinds))
    while True:
        for g in range(s + 1, e):
            if kinds[g] == 1 and kinds[g - 1] != 1:
                end = g
                while end < len(kinds) and kinds[end] == 1:
                    end += 1
                if end > e or kinds[end:e].count(0) < kept:
                    e = g
                    break
        else:
            return e


def starts_of(kinds, n, kept, origin=None, settle=True):
    total = len(kinds)
    if origin is None or not 0 < origin < total:
        origin = 0
    if origin and settle:
        cost = {}
        for shift in range(n // 2 + 1):
            if origin - shift > 0:
                ends = [origin - shift - k * n for k in range(20)]
                cost[shift] = sum(1 << 19 - k for k, e in enumerate(ends) if e > 0 and orphaned(kinds, max(0, e - n), e, kept))
        origin -= min(cost, key=lambda s: (cost[s], s))
    out, e, s = [], origin, origin
    while e > 0:
        e = max(0, e - n)
        out.append(e)
    while s < total:
        out.append(s)
        s = column_end(kinds, s, n, kept)
    return sorted(out)


@pytest.mark.parametrize(("per_column", "kept", "size"), [(12, 2, 4096), (5, 2, 7), (9, 3, 4), (1, 1, 10)])
def test_columns(spark, per_column, kept, size):
    rng = random.Random(per_column)
    docs = {k: [rng.choices([0, 1, 2], rng.choice([(6, 2, 1), (2, 3, 1), (20, 1, 1)]))[0] for _ in range(rng.randint(1, 150))] for k in range(30)}
    docs |= {100: [1] * 30, 101: [2] * 30, 102: [0] * 30, 103: [1], 104: [0] * 11 + [1] * 14 + [0] * 9}
    lines = spark.createDataFrame([(k, i, kind, "x") for k, kinds in docs.items() for i, kind in enumerate(kinds)] + [(None, 0, 0, "y")], "k int, pos int, kind int, start string").repartition(5)

    def check(got, want):
        found = {k: [] for k in docs}
        for r in got.collect():
            found[r.k].append(r.start)
        assert {k: sorted(v) for k, v in found.items()} == want

    check(layout.columns(lines, ["k"], per_column, kept, size=size), {k: starts_of(v, per_column, kept) for k, v in docs.items()})
    origins = {k: rng.choice([0, -3, len(v), len(v) // 2, len(v) - 1, rng.randint(0, len(v))]) for k, v in docs.items() if rng.random() < 0.9}
    frame = spark.createDataFrame(list(origins.items()), "k int, origin int")
    for settle in (True, False):
        check(layout.columns(lines, ["k"], per_column, kept, frame, settle, size=size), {k: starts_of(v, per_column, kept, origins.get(k), settle) for k, v in docs.items()})
