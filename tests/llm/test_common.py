"""Connected components against a walk."""

import random

import numpy as np
import pytest

from seriesloom.llm import common


def walk(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, seen = {}, set()
    for n in sorted(near):
        todo = [n] if n not in seen else []
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                out[m] = n
                todo += near[m]
    return {n: r for n, r in out.items() if n != r}


def graphs():
    rng = random.Random(1)
    yield [(i, i + 1) for i in range(200)]  # a path
    yield [(0, i) for i in range(1, 100)] + [(500, 500)]
    yield [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(350)]
    mixed = list(range(400))
    rng.shuffle(mixed)
    yield list(zip(mixed[:-1], mixed[1:]))[::2] + list(zip(mixed, mixed[3:]))[::5] + [(7, 9)] * 20


@pytest.mark.parametrize("links", [1 << 21, 16])
def test_components(spark, monkeypatch, links):
    monkeypatch.setattr(common, "LINKS", links)
    for pairs in graphs():
        df = spark.createDataFrame(pairs, "x long, y long").repartition(7)
        got = {r["node"]: r["root"] for r in common.connected(df, "x", "y").collect()}
        assert got == walk(pairs)
    assert common.connected(df.limit(0), "x", "y").count() == 0


def test_stars_of_a_block():
    for pairs in graphs():
        p = np.array([x for x in pairs if x[0] != x[1]], np.int64)
        low, node = common.smallest(p.min(1), p.max(1))
        assert dict(zip(node.tolist(), low.tolist())) == walk([x for x in pairs if x[0] != x[1]])
