"""Components against union-find, all links at once and in two parts."""

import random

import pytest

from runledger.llm import shared
from runledger.llm.components import components


def _expected(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def _cases():
    rng = random.Random(7)
    yield "path", [(i, i + 1) for i in range(40)], 20
    yield "star with several leaders", [(lo, i) for lo in (1, 2) for i in range(3, 30)] + [(50, 51)], 30
    yield "random", [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], 25
    yield "no later links", [(1, 2), (2, 3)], 2
    yield "no earlier links", [(5, 4), (4, 9), (4, 9)], 0
    yield "none", [], 0


@pytest.mark.parametrize(("name", "links", "cut"), [pytest.param(*c, id=c[0]) for c in _cases()])
def test_components(spark, name, links, cut):
    work = shared.Workspace(spark, "components-test")
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    want = {k: v for k, v in _expected(links).items() if any(k in p for p in links if p[0] != p[1])}
    whole = components(frame(links), work, "whole")
    first = work.save(components(frame(links[:cut]), work, "first"), "known")
    both = components(frame(links[cut:]), work, "later", first)
    for got in (whole, both):
        rows = [(r.id, r.component) for r in got.collect()]
        assert len(rows) == len(set(rows)) == len(dict(rows)), name
        assert dict(rows) == want, name
