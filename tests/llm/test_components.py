"""Components of chains and trees against union-find; each alone, as other components keep the loop going."""

import numpy as np
import pytest

from logsieve.llm.components import components


def least_of(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent if root(x) != x}


def chain(seed, n):
    x = np.random.default_rng(seed).permutation(n).tolist()
    return list(zip(x, x[1:], strict=False))


def tree(seed, n):
    random = np.random.default_rng(seed)
    x = random.permutation(n).tolist()
    return [(x[i], x[random.integers(i)]) for i in range(1, n)]


@pytest.mark.parametrize(
    "edges",
    [[(1, 3), (3, 4), (4, 6), (6, 5), (5, 2)], *[chain(i, 7) for i in range(4)], *[tree(i, 10) for i in range(4)], chain(9, 40)],
)
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.u, r.v) for r in found) == sorted(least_of(edges).items())
