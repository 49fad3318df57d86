"""Connected components against union-find."""

from __future__ import annotations

import random

import pytest

from corpusloom.llm.components import components


def _want(edges):
    top = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {x: find(x) for x in top}


_rng = random.Random(3)
GRAPHS = {
    "none": [],
    "loop": [(1, 1), (2, 3), (3, 2), (2, 3)],
    "path": [(i, i + 1) for i in _rng.sample(range(60), 60)],
    "hub": [(100, i) for i in range(80)] + [(i, 200 + i) for i in range(5)],
    "random": [(_rng.randrange(200), _rng.randrange(200)) for _ in range(130)],
    "two smaller": [(9, 1), (9, 2), (8, 2)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    got = components(spark.createDataFrame(GRAPHS[name], "a long, b long"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == _want(GRAPHS[name])
