import math
import random

import numpy as np
import pytest

from adjudica.llm import balltree as B


def plain(rows, every, k, scale=64):
    """All rows by all queries; a row is no candidate for itself alone."""
    points = []
    for i, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        points.append((i, [math.floor(x) * scale if abs(x) > 2**60 else math.floor(scale * x) for x in v]))
    out = []
    for n, (i, q) in enumerate(points):
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, p)), j is None, j or 0) for m, (j, p) in enumerate(points) if m != n)[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(scored, 1)]
    return sorted(out, key=str)


def rows_for(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(dim)]) for i in range(n)]
    hot = [0.5] * dim
    rows += [(n + i, hot) for i in range(n // 3)]
    rows += [(5 * n, None), (5 * n + 20, [None] * dim), (5 * n + 40, [float("nan")] + [0.0] * (dim - 1)), (5 * n + 60, [float("inf")] * dim), (None, hot), (40, rows[40][1]), (-20, hot), (5 * n + 80, [0.25]), (5 * n + 100, [])]
    return rows


@pytest.mark.parametrize("seed, shard, block, every, k", [(1, 60, 7, 5, 4), (2, 1000, 1000, 20, 20), (3, 40, 50, 1, 3)])
def test_against_all_scores(spark, seed, shard, block, every, k):
    rows = rows_for(240, 6, seed)
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = B.top_k(df, every=every, k=k, shard=shard, block=block).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, every, k)


def test_pruning_reads_few_leaves_and_large_numbers_stay_exact():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 300, (40, 8))
    points = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 5, (8000, 8))).astype(np.int64)
    for scale in (1, 2**20):
        tree = B.build(np.arange(8000), points * scale, 6, leaf=50)
        queries = points[::400] * scale
        (query, ids, scores), read = B.search(tree, queries, np.full(20, np.iinfo(np.int64).min), 5)
        want = queries.astype(object) @ (points * scale).astype(object).T
        for q in range(20):
            order = sorted(range(8000), key=lambda j: (-want[q, j], j))[:5]
            assert ids[query == q].tolist() == order and scores[query == q].tolist() == [want[q, j] for j in order]
        assert read < 20 * tree["leaf"].sum() / 3


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert B.top_k(spark.createDataFrame([], schema)).collect() == []
    assert B.top_k(spark.createDataFrame([(20, [1.0])], schema)).collect() == []
    got = B.top_k(spark.createDataFrame([(20, [1.0]), (3, [2.0])], schema)).collect()
    assert [tuple(r) for r in got] == [(20, 1, 3, 64 * 128)]


def test_large_components_repeated_and_null_ids(spark):
    """Components of 1e10, of which only some scores are longs beyond 2**53; ids that repeat; null ids that tie."""
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(60)]
    rows += [(100, [1e3, 9e3, -3.5, 0.0]), (101, [1e10, 9e9, 0.0, 0.0]), (102, [9e9, 1e10, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5, 0.5])]
    rows += [(20, [0.5] * 4), (20, [0.5] * 4), (20, [2.0] * 4), (40, rows[40][1]), (7, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard, block, k in ((8, 3, 5), (1000, 1000, 20), (16, 4, 80)):
        got = B.top_k(df, every=20, k=k, shard=shard, block=block).collect()
        assert sorted(map(tuple, got), key=str) == plain(rows, 20, k)


def test_scores_that_are_no_long_raise(spark):
    schema = "vec_id long, embedding array<double>"
    alone = [(20, [1e10] * 64), (3, [1.0] * 64), (5, [-1.0] * 64)]  # only the query's own product has no long
    got = B.top_k(spark.createDataFrame(alone, schema)).collect()
    assert sorted(map(tuple, got), key=str) == plain(alone, 20, 20)
    with pytest.raises(Exception, match="no long"):
        B.top_k(spark.createDataFrame([*alone, (4, [1e10] * 64)], schema)).collect()


def test_root_balls_spare_most_trees():
    rng = np.random.default_rng(3)
    points = np.floor(np.repeat(rng.normal(0, 3000, (16, 8)), 100, axis=0) + rng.normal(0, 5, (1600, 8)))
    top = B.Top(points[::3], 4)
    cells = top.cells(points)
    balls = [B.build(np.arange((cells == c).sum()), points[cells == c], 6) for c in np.unique(cells)]
    assert len(balls) > 8 and max((cells == c).sum() for c in np.unique(cells)) < 400
    bound = B.bounds(points[:1], np.array([b["centre"][0] for b in balls]), np.array([b["radius"][0] for b in balls]), np.abs(points).max())
    assert (bound[0] >= np.sort(points[0] @ points.T)[-20]).sum() <= 3
