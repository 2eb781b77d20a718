import random
from collections import Counter, defaultdict

import pytest

from codexloom.llm.packing import CapacityTree, plan


def best_fit_decreasing(lengths, capacity):
    """Remaining capacities, by scanning all open sequences for each piece."""
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= length
        else:
            room.append(capacity - length)
    return sorted(room)


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
    placed, seen = defaultdict(list), Counter()
    for length, rank, n, first, offset in plan(dict(Counter(lengths)), capacity):
        assert rank == seen[length]
        seen[length] += n
        for i in range(n):
            placed[first + i].append((offset, length))
    assert seen == Counter(lengths)
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(x for _, x in own) for own in placed.values()) == best_fit_decreasing(lengths, capacity)


def test_tree_finds_the_tightest():
    tree = CapacityTree(20)
    for x in (3, 7, 20):
        tree.set(x, True)
    assert [tree.tightest(x) for x in (1, 3, 4, 8, 20)] == [3, 3, 7, 20, 20]
    tree.set(20, False)
    assert tree.tightest(8) == -1
