import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from silterra.llm import covertree as cv


def brute(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    s = np.round(x @ x.T, cv.DIGITS)
    out = {}
    for r, i in enumerate(ids):
        best = sorted((-s[r, c], j) for c, j in enumerate(ids) if j != i)[:k]
        out[i] = [(j, -d) for d, j in best]
    return out


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim)) * 4
    x = centres[rng.integers(9, size=n)] + rng.normal(size=(n, dim)) * 0.3
    x[n // 2 : n // 2 + 40] = x[3]
    return {int(i) * 3 + 1: x[i].tolist() for i in range(n)}


def test_tree_covers_and_separates():
    x = np.array(list(clustered(900, 5).values()))
    tree = cv.CoverTree(np.arange(900), x)
    assert sorted(tree.ids) == list(range(900)) and (tree.x == cv._unit_rows(x)[tree.ids]).all()
    for node in range(len(tree.begin)):
        inside = tree.x[tree.begin[node] : tree.end[node]]
        assert cv.CoverTree._far(inside, tree.centre[node]).max() <= tree.radius[node] + 1e-12
        a, z = tree.child[node]
        if z:
            assert tree.begin[a] == tree.begin[node] and tree.end[z - 1] == tree.end[node]
            gap = min(np.linalg.norm(tree.centre[i] - tree.centre[j]) for i in range(a, z) for j in range(a, i)) if z - a > 1 else 9
            assert gap >= tree.radius[a:z].max() - 1e-9


@pytest.mark.parametrize(("n", "dim", "cell"), [(700, 6, 64), (500, 32, 4096)])
def test_equal_to_brute_force(spark, n, dim, cell):
    vectors = clustered(n, dim)
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(cv.neighbours(rows, 7, None, cell, 40_000).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.neighbour_id, r.similarity))
    assert got == brute(vectors, 7)


def test_query_set_and_hot_copies(spark):
    vectors = clustered(900, 8, seed=2)
    for i in list(vectors)[::3]:
        vectors[i] = [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 3.0]
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    got = {}
    for r in sorted(cv.neighbours(rows, 5, F.expr("vec_id % 100 = 0"), 64).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.neighbour_id, r.similarity))
    want = brute({i: np.array(v, np.float32).astype(float) for i, v in vectors.items()}, 5)
    assert got == {i: v for i, v in want.items() if i % 100 == 0}
    assert cv.neighbours(rows, 5, F.expr("vec_id < 0")).count() == 0


def test_pruning_skips_work():
    vectors = clustered(2000, 3, seed=4)
    tree = cv.CoverTree(np.array(list(vectors)), np.array([np.array(v) / np.linalg.norm(v) for v in vectors.values()]))
    search = cv.Search(tree, 5)
    seen = []
    compare = search._compare
    search._compare = lambda node, rows, data: (seen.append(len(rows) * (tree.end[node] - tree.begin[node])), compare(node, rows, data))
    search.against(tree)
    assert sum(seen) < 0.6 * 2000 * 2000


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [2.0]), (8, [0.0, 3.0]), (8, [0.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (10, [float("inf"), 0.0])]
    docs = spark.createDataFrame([Row(vec_id=i, embedding=e, rank="mine", pivot=None, tree=1) for i, e in rows], "vec_id long, embedding array<double>, rank string, pivot string, tree int")
    got = sorted((r.query_id, r["rank"], r.neighbour_id, r.similarity) for r in cv.neighbours(docs, 2).collect())
    assert got == [(1, 1, 7, 1.0), (1, 2, 8, 0.0), (7, 1, 1, 1.0), (7, 2, 8, 0.0), (8, 1, 1, 0.0), (8, 2, 7, 0.0), (9, 1, 8, 0.0), (9, 2, 1, -1.0)]
    assert cv.neighbours(docs.limit(0)).count() == 0
    assert cv.neighbours(docs.where("vec_id = 4")).count() == 0
    assert cv.neighbours(docs.where("vec_id = 1")).count() == 0
