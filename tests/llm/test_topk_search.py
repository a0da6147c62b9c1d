import random

import numpy as np
import pytest
from jointflow.llm import topk_search as t

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_force(rows, step, k):
    table = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = tuple(float(np.floor(np.float64(np.float32(x)) * 256)) for x in v)
            table[i] = min(table.get(i, w), w)
    out = []
    for q in table:
        if q % step == 0:
            scored = [(-int(np.dot(table[q], v)), i) for i, v in table.items() if i != q and len(v) == len(table[q])]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def mine(spark, rows, step, k, **options):
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS vector", "2 AS block", "3 AS size")
    vectors = t.whole_vectors(df)
    got = t.top_k(vectors, vectors.where(f"vec_id % {step} = 0"), k, **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


def vectors(n, dim, seed=0, grid=False):
    rng = np.random.default_rng(seed)
    make = (lambda: rng.integers(-2, 3, dim) / 256) if grid else (lambda: rng.normal(0, 0.2, dim))
    return [(i, [float(x) for x in make()], 0) for i in range(n)]


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("block", [10**6, 900])
def test_against_brute_force(spark, grid, block):
    rows = vectors(300, 6, grid=grid)
    assert mine(spark, rows, 7, 5, block_components=block) == brute_force(rows, 7, 5)


def test_odd_rows(spark):
    rows = vectors(40, 3) + [
        (None, [1.0, 1.0, 1.0], 0),
        (100, None, 0),
        (101, [], 0),
        (103, [], 0),
        (104, [1.0, None, 2.0], 0),
        (105, [1.0, float("nan"), 2.0], 0),
        (106, [float("inf"), 0.0, 0.0], 0),
        (107, [0.5, 0.5], 0),
        (110, [0.25, 0.5], 0),
        (5, [0.1, 0.2, 0.3], 0),
        (5, [0.1, 0.2, 0.3], 0),
        (-10, [0.9, 0.9, 0.9], 0),
    ] + [(200 + i, [0.5, 0.5, 0.5], 0) for i in range(300)]
    assert mine(spark, rows, 5, 4) == brute_force(rows, 5, 4)


def test_fewer_than_k_and_none(spark):
    rows = vectors(3, 4)
    assert mine(spark, rows, 1, 5) == brute_force(rows, 1, 5)
    assert mine(spark, rows[:1], 1, 5) == [] == mine(spark, [], 1, 5)


def test_cover_tree():
    rng = random.Random(1)
    points = np.array([[rng.choice([rng.gauss(0, 30), 5.0]) for _ in range(4)] for _ in range(500)])
    tree = t.CoverTree(np.concatenate([points, points[:50]]), leaf=4)
    seen = []

    def below(node):
        kids = tree.children[node]
        rows = np.concatenate([below(c) for c in kids]) if kids else tree.rows[node]
        far = np.linalg.norm(tree.points[rows] - tree.points[tree.center[node]], axis=1)
        assert far.max() <= tree.radius[node] + 1e-9
        centers = tree.points[[tree.center[c] for c in kids]]
        for i in range(len(kids)):
            gaps = np.linalg.norm(centers[:i] - centers[i], axis=1)
            # Children are apart by more than their common covering radius.
            assert i == 0 or gaps.min() > max(tree.radius[c] for c in kids) - 1e-9
        if not kids:
            seen.extend(rows.tolist())
        return rows

    below(0)
    assert sorted(seen) == list(range(550))


def test_the_walk_leaves_pairs_out():
    rng = np.random.default_rng(3)
    points = np.floor(np.concatenate([rng.normal(c, 1, (400, 3)) for c in (0, 60, -60, 200)]) * 16)
    calls = []
    plain = t.Best.add
    try:
        t.Best.add = lambda self, rows, scores, ids: (calls.append(scores.size), plain(self, rows, scores, ids))[1]
        t.search(points[1200:1300], np.arange(1200, 1300), points, np.arange(len(points)), 3)
    finally:
        t.Best.add = plain
    assert sum(calls) < 0.5 * 100 * len(points)
