import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from uttermark.llm.negatives import hard_negatives
from uttermark.llm.topk import CoverTree, Search, bound, top_k
from uttermark.llm.whole import best, products

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def odd_rows(rng, n, length=6, labels=3):
    """Clusters, copies, ties, odd lengths and all that takes no part."""
    rows = []
    for i in range(n):
        center = np.sin(np.arange(length) * (1 + i % 5)) * (1 + i % 3)
        rows.append((i, [float(x) for x in center + rng.normal(0, 0.3, length)], i % labels))
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 40, 3)]  # copies under other ids
    rows += [rows[0], rows[50], rows[50]]  # repeated rows, queries among them
    rows += [(2000 + i, [float(i % 2), 1.0], i % 2) for i in range(30)]  # another length, many ties
    rows += [(3000, [], 0), (3001, [], 1), (3050, [], 1)]
    rows += [(None, [1.0] * length, 0), (4000, None, 0), (4001, [math.nan] * length, 0),
             (4002, [None] + [1.0] * (length - 1), 1), (4003, [math.inf] * length, 1),
             (4004, [1e9] * length, 1), (4050, [1.0] * length, None)]
    random.Random(2).shuffle(rows)
    return rows


def taking_part(rows, scale):
    for i, (vec_id, vector, label) in enumerate(rows):
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(scale * x) for x in vector]
        if math.sqrt(sum(x * x for x in whole)) < 2**28:
            yield i, vec_id, whole, label


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k, every):
    found, own = [], list(taking_part(rows, 1024))
    for i, query_id, q, _ in own:
        if query_id % every == 0:
            scored = sorted((-dot(q, v), vec_id) for j, vec_id, v, _ in own if j != i and len(v) == len(q))
            found += [(query_id, n + 1, vec_id, -s) for n, (s, vec_id) in enumerate(scored[:k])]
    return sorted(found)


def brute_negatives(rows, every):
    found, own = [], [r for r in taking_part(rows, 256) if r[3] is not None]
    for i, anchor_id, a, label in own:
        if anchor_id % every:
            continue
        others = [(-dot(a, v), vec_id, x) for j, vec_id, v, x in own if j != i and len(v) == len(a)]
        for s, positive_id in sorted((s, v) for s, v, x in others if x == label)[:5]:
            inside = sorted((n, v) for n, v, x in others if x != label and 50 * -s <= 100 * -n <= 95 * -s)
            found += [(anchor_id, positive_id, r + 1, v, -s, -n) for r, (n, v) in enumerate(inside[:3])]
    return sorted(found)


@pytest.mark.parametrize("part, group, chunk", [(2048, 256, 1024), (16, 4, 8)])
def test_top_k_equals_brute_force(spark, part, group, chunk):
    rows = odd_rows(np.random.default_rng(4), 150)
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = top_k(vectors, F.col("vec_id") % 10 == 0, k=7, part=part, group=group, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 7, 10)


def test_top_k_without_queries_or_rows_and_with_clashing_columns(spark):
    vectors = spark.createDataFrame(odd_rows(np.random.default_rng(1), 60), SCHEMA)
    assert top_k(vectors, F.col("vec_id") < 0).count() == 0
    assert top_k(vectors.limit(0), F.lit(True)).count() == 0
    assert hard_negatives(vectors.limit(0), F.lit(True)).count() == 0
    wide = vectors.withColumns({c: F.lit("x") for c in ("uid", "score", "rank", "node", "length", "vector", "anchor")})
    assert top_k(wide, F.col("vec_id") % 10 == 0).count() > 0
    assert hard_negatives(wide, F.col("vec_id") % 10 == 0).count() > 0


def test_hard_negatives_equal_brute_force(spark):
    rows = odd_rows(np.random.default_rng(7), 160)
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 5)


def test_a_tree_holds_each_point_once_and_covers_it():
    rng = np.random.default_rng(3)
    points = np.rint(rng.normal(0, 100, (700, 5)))
    points[100:200] = points[0]
    tree = CoverTree(points, leaf=16)
    leaves = [m for m, c in zip(tree.members, tree.children) if not c]
    assert sorted(np.concatenate(leaves).tolist()) == list(range(700))
    for members, center, radius, children in zip(tree.members, tree.centers, tree.radii, tree.children):
        assert (np.sqrt(((points[members] - center) ** 2).sum(axis=1)) <= radius).all()
        picks = tree.centers[children]
        if len(children) > 1:  # a net: no two centers nearer than the farthest point is to its own
            apart = min(np.linalg.norm(a - b) for i, a in enumerate(picks) for b in picks[:i])
            assert apart >= max(tree.radii[children]) - 1e-9


def test_clustered_data_is_pruned_and_nothing_is_lost():
    rng = np.random.default_rng(8)
    directions = rng.normal(0, 1, (40, 16))
    data = np.rint(np.repeat(directions, 50, axis=0) * 1000 + rng.normal(0, 5, (2000, 16)))
    queries = np.rint(directions[0] * 1000 + rng.normal(0, 5, (30, 16)))
    state = Search(np.arange(30) + 10_000, queries, np.full(30, -(1 << 62)), 10)
    place = np.arange(30)
    state.walk(CoverTree(queries), place, CoverTree(data), np.arange(2000), np.arange(2000))
    exact = queries.astype(np.int64) @ data.astype(np.int64).T
    assert (state.scores == -np.sort(-exact, axis=1)[:, :10]).all()
    assert state.visited < 0.3 * exact.size


def test_bound_holds():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b, r, s = rng.normal(0, 9, 4), rng.normal(0, 9, 4), *rng.uniform(0, 5, 2)
        x, y = a + r * unit(rng), b + s * unit(rng)
        assert x @ y <= bound(a @ b, np.linalg.norm(a), r, np.linalg.norm(b), s)


def unit(rng):
    v = rng.normal(0, 1, 4)
    return v / np.linalg.norm(v)


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[2.0**27, 3.0]]), np.array([[2.0**27, 1.0]])
    assert products(a, b)[0, 0] == 2**54 + 3
    assert [list(x) for x in best(np.array([[5, 7, 7, 1]]), 2)] == [[0, 0], [1, 2], [7, 7]]
