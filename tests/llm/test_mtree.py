import math

import numpy as np
import pytest

from lodestone.llm import mtree


def plain(ids, vectors, queries, k):
    out = set()
    for q, v in queries:
        all_ = sorted((-int(np.dot(v, x)), i) for i, x in zip(ids, vectors, strict=True) if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(all_, 1)}
    return out


@pytest.mark.parametrize(("n", "dims", "spread"), [(700, 6, 40), (300, 3, 2), (30, 4, 5)])
def test_equals_brute_force_with_ties_and_clusters(spark, n, dims, spread, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 150)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 20)
    monkeypatch.setattr(mtree, "PAGE", 8)
    monkeypatch.setattr(mtree, "FANOUT", 3)
    rng = np.random.default_rng(n)
    centers = rng.integers(-50, 50, (5, dims))
    vectors = centers[rng.integers(0, 5, n)] + rng.integers(-spread, spread + 1, (n, dims))
    vectors[: n // 3] = vectors[0]  # one vector holds a third of all rows
    ids = rng.permutation(5 * n)[:n]
    df = spark.createDataFrame([(int(i), [int(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "id long, v array<long>")
    df = df.unionByName(df.limit(5))
    queries = [(int(i), v) for i, v in zip(ids, vectors, strict=True) if i % 5 == 0]
    got = {tuple(r) for r in mtree.top_k(df, df.where("id % 5 = 0"), 20).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == plain(ids.tolist(), vectors, queries, 20)


def test_pages_are_skipped():
    rng = np.random.default_rng(0)
    centers = rng.integers(-400, 400, (40, 8))
    x = (np.repeat(centers, 200, axis=0) + rng.integers(-3, 4, (8000, 8))).astype(np.float64)
    reach = float((x * x).sum(axis=1).max())
    tree = mtree.build(x, np.arange(8000), 5, reach)
    seen = []
    inner = tree.vectors
    tree.vectors = type("Spy", (), {"__getitem__": lambda self, at: seen.append(len(np.atleast_1d(at))) or inner[at]})()
    q = x[:1]
    row, ids, scores = mtree.search(tree, q, np.array([0]), 5, reach)
    assert sum(seen) < 4000
    want = sorted((-int(s), i) for i, s in enumerate(x @ q[0]) if i != 0)[:5]
    assert sorted(zip((-scores).tolist(), ids.tolist(), strict=True)) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [0.5, -0.25]), (1, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (None, [1.0, 1.0]), (6, [0.499, -0.001]), (7, [1.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as score")
    v = mtree.scaled(df, "embedding", "vec_id")
    assert {r["id"]: r["v"] for r in v.collect()} == {20: [32, -16], 1: [64, 64], 6: [31, -1], 7: [64]}
    got = [tuple(r) for r in mtree.top_k(v, v.where("id % 20 = 0"), 20).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 1024), (20, 2, 6, 1008)]
    assert mtree.top_k(v.limit(0), v.limit(0)).count() == 0
    assert mtree.top_k(v, v.limit(0)).count() == 0


def plain_top(rows, k, every):
    q = [(i, v) for i, v in rows if i % every == 0]
    out = []
    for i, v in q:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size", [1e6, 3e6])
def test_large_values_are_exact(spark, size):
    rng = np.random.default_rng(3)
    given = [(i, [float(x) for x in rng.normal(0, size, 8)]) for i in range(300)]
    given += [(400 + i, given[0][1]) for i in range(5)] + [(500, [1e30] * 8), (501, [float("inf")] * 8)]
    df = mtree.scaled(spark.createDataFrame(given, "vec_id long, embedding array<double>"), "embedding", "vec_id")
    got = mtree.top_k(df, df.where("id % 10 = 0"), 7)
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in given if i < 500]
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_top(rows, 7, 10)


def test_one_tree_for_each_shard(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 64)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 16)
    built = spark.sparkContext.accumulator(0)
    plain = mtree.build

    def build(*args):
        built.add(1)
        return plain(*args)

    monkeypatch.setattr(mtree, "build", build)
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) for x in rng.integers(-40, 40, 6)]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = mtree.top_k(df, df.where("id % 5 = 0"), 9).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == plain_top(rows, 9, 5)
    assert built.value in (0, -(-500 // 64))  # 0: workers have modules of their own
