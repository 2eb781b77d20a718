"""Interval sweeps and pairings against all pairs."""

import random

import pytest

from codexloom.operators import intervals

SPAN = "k int, start long, end long, {} string"


def disjoint(rng, n, far=60):
    at, out = rng.randint(0, 5), []
    for i in range(n):
        end = at + rng.choice([0, 1, 3, 10, far])
        out.append((at, end, f"{i}"))
        at = end + rng.choice([0, 0, 2, 7])
    return out


@pytest.mark.parametrize("size", [1, 8, 10**6])
def test_pieces_and_first_overlap(spark, size):
    rng = random.Random(size)
    left = [(k, *x) for k in range(6) for x in disjoint(rng, 12)] + [(9, 0, 10**9, "long"), (None, 0, 5, "x"), (7, 3, None, "n")]
    right = [(k, *x) for k in range(6) for x in disjoint(rng, 9, 25)] + [(9, 5, 7, "a"), (9, 7, 10**8, "b"), (8, 0, 4, "alone")]
    a, b = spark.createDataFrame(left, SPAN.format("run")).repartition(3), spark.createDataFrame(right, SPAN.format("link")).repartition(3)
    want = set()
    for k, s, e, run in left:
        if k is not None and e is not None and s < e:
            over = sorted((max(s, x), min(e, y), v) for j, x, y, v in right if j == k and x < y and max(s, x) < min(e, y))
            at = s
            for x, y, v in over:
                want |= {(k, run, at, x, None)} if x > at else set()
                want.add((k, run, x, y, v))
                at = y
            want |= {(k, run, at, e, None)} if at < e else set()
    got = [(r.k, r.run, r.start, r.end, r.link) for r in intervals.pieces(a, b, ["k"], "run", "link", size).collect()]
    # Bounds of right intervals between two left ones cut nothing, so equal neighbours need no joining.
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    firsts = {(k, s, e, run): min(((x, v) for j, x, y, v in right if j == k and x < y and x < e and y > s), default=(0, None))[1] for k, s, e, run in left if k is not None and e is not None}
    found = intervals.first_overlap(a, b, ["k"], "link", size).filter("end is not null").collect()
    assert {(r.k, r.start, r.end, r.run): r.link for r in found} == firsts and len(found) == len(firsts)
    assert intervals.pieces(a.limit(0), b, ["k"], "run", "link").collect() == []


@pytest.mark.parametrize("size", [2, 4096])
def test_paired(spark, size):
    rng = random.Random(5)
    rows = lambda n: [(k, i, rng.choice([None, "a", "b", "c", f"x{rng.randint(0, 9)}"])) for k in range(15) for i in range(rng.randint(0, n))]
    marks, bodies = rows(9), rows(9)
    want = {}
    for k in range(15):
        own, other = ([(i, n) for j, i, n in x if j == k] for x in (marks, bodies))
        named = {i: next((b for b, m in other if n is not None and m == n), None) for i, n in own}
        free = [b for b, _ in other if b not in named.values()]
        for i, _ in own:
            want[k, i] = named[i] if named[i] is not None else free.pop(0) if free else None
    frame = lambda x: spark.createDataFrame(x, "k int, i int, name string").repartition(4)
    got = intervals.paired(frame(marks), frame(bodies), ["k"], "i", "name", size).collect()
    assert {(r.k, r.i): r.body for r in got} == want and len(got) == len(want)
