import random

import pytest
from helpers import frame

from vellum.llm.common import components


def brute(edges):
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in root}


CHAIN = [(i, i + 1) for i in range(60)]
SHAPES = [CHAIN, CHAIN[::-1] + [(100, 60)], [(0, i) for i in range(1, 50)], [(5, 5), (7, 6), (6, 7)], []]


@pytest.mark.parametrize("edges", SHAPES + [[(r.randrange(80), r.randrange(80)) for _ in range(50)] for r in map(random.Random, range(2))])
def test_components(spark, edges):
    frame(spark, [])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {v: r for v, r in brute(edges).items() if any(a != b and v in (a, b) for a, b in edges)}
    assert got == expected
