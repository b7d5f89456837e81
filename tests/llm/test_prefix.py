"""Links of sets around common ones against all pairs."""

import numpy as np
import pytest

from logsieve.llm import prefix


def made(seed, n):
    """Sets that lack some of a base's items and have others: own ones, or of a few variants that they share."""
    random = np.random.default_rng(seed)
    bases = [set(random.integers(0, 1 << 40, int(k)).tolist()) for k in random.integers(20, 80, 3)]
    variants = [random.integers(0, 1 << 40, 6).tolist() for _ in range(4)]
    out = set()
    while len(out) < n:
        base = bases[random.integers(3)]
        s = {x for x in base if random.random() > random.choice([0, 0.05, 0.1, 0.2])}
        s |= set(random.integers(0, 1 << 40, int(random.choice([0, 1, 3, 8]))).tolist())
        for v in variants:
            if random.random() < 0.3:
                s |= set(v[: int(random.integers(1, 6))])
        if random.random() < 0.2:  # a part of the base alone
            s = set(sorted(base)[: int(len(base) * random.choice([0.75, 0.85, 0.95]))])
        out.add(frozenset(s))
    return sorted(out, key=sorted)


def like(x, y, p):
    return 100 * len(x & y) >= p * len(x | y)


def groups(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def same(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80), (3, 70), (4, 90)])
def test_candidates(spark, seed, percent):
    sets = made(seed, 250)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "v int, items array<bigint>")
    links, pairs = prefix.candidates(df, percent)
    links = [(r.a, r.b) for r in links.collect()]
    assert all(like(sets[a], sets[b], percent) for a, b in links)
    open_ = {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()}
    found = links + [(a, b) for a, b in open_ if like(sets[a], sets[b], percent)]
    every = [(i, j) for i in range(len(sets)) for j in range(i) if like(sets[i], sets[j], percent)]
    assert same(groups(len(sets), found), groups(len(sets), every))
    assert len(open_) < len(sets) * (len(sets) - 1) // 4


def test_ranked_takes_sets_alone(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5, 6])], "v int, items array<bigint>")
    links, pairs = prefix.candidates(df, 80)
    assert links.isEmpty() and pairs.isEmpty()
