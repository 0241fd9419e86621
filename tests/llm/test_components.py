import random

import pytest

from lodestone.llm import components as c


def want(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


def got(spark, edges):
    return {r["node"]: r["root"] for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(70)]
    edges = [e for e in edges if e[0] != e[1]]
    assert got(spark, edges) == want(edges)


def test_chain_star_and_none(spark):
    chain = [(i, i + 1) for i in range(40)]
    assert got(spark, chain) == want(chain)
    star = [(1000, i) for i in range(200)] + [(1000, 1000)]
    assert got(spark, star) == {i: 0 for i in [*range(200), 1000]}
    assert got(spark, []) == {}


def test_hot_nodes_go_apart(spark, monkeypatch):
    monkeypatch.setattr(c, "HOT_SHARE", 2)
    edges = [(0, i) for i in range(1, 1300)] + [(i, i + 5000) for i in range(1, 30)]
    assert got(spark, edges) == want(edges)
