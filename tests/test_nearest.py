"""Tree searches against plain loops, with a third of all points at one place."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentframe.operators import nearest, space
from agentframe.operators.space import SpaceSpec

PLANE, ROUND = SpaceSpec(100.0, 60.0, 5.0), SpaceSpec(100.0, 60.0, 5.0, torus=True)


def cloud(seed, n, hot=0.33):
    rng = np.random.default_rng(seed)
    xy = np.where(rng.random((n, 1)) < 0.5, rng.random((n, 2)) * (100, 60), rng.normal((70, 20), 0.5, (n, 2)))
    xy[rng.random(n) < hot] = (12.5, 40.0)
    return [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(n), xy, strict=True)]


def gap(spec, a, b):
    side = lambda u, v, n: min(abs(u - v), n - abs(u - v)) if spec.torus else abs(u - v)
    dx, dy = side(a[1], b[1], spec.width), side(a[2], b[2], spec.height)
    return math.sqrt(dx * dx + dy * dy)


def table(spark, rows):
    return spark.createDataFrame(rows, "idx long, px double, py double").repartition(5)


@pytest.fixture(scope="module")
def clouds():
    return cloud(1, 150), cloud(2, 1200)


@pytest.mark.parametrize(("spec", "k"), [(PLANE, 1), (ROUND, 7)])
def test_k_nearest(spark, clouds, spec, k):
    queries, points = clouds
    got = nearest.k_nearest(table(spark, queries), table(spark, points), spec, k).collect()
    assert len(got) == k * len(queries)
    want = {(q[0], n + 1): (i, d) for q in queries for n, (d, i) in enumerate(sorted((gap(spec, q, p), p[0]) for p in points)[:k])}
    assert {(r.idx, r["rank"]): (r.q_idx, r.dist) for r in got} == want


@pytest.mark.parametrize(("spec", "radius"), [(ROUND, 9.0), (PLANE, 45.0), (PLANE, float("inf"))])
def test_within_and_pairs(spark, clouds, spec, radius):
    queries, points = clouds
    seen = {q[0]: [p for p in points if gap(spec, q, p) <= radius] for q in queries}
    got = {r.idx: r for r in nearest.within(table(spark, queries), table(spark, points), spec, radius).collect()}
    assert {k: r.n for k, r in got.items()} == {k: len(v) for k, v in seen.items() if v}
    assert all(math.isclose(got[k].sx, sum(p[1] for p in v)) and math.isclose(got[k].sy, sum(p[2] for p in v)) for k, v in seen.items() if v)
    pairs = nearest.pairs_within(table(spark, queries), table(spark, points), spec, radius).collect()
    assert sorted((r.idx, r.q_idx) for r in pairs) == sorted((k, p[0]) for k, v in seen.items() for p in v)


def test_few_points_none_and_nulls(spark):
    queries, points = table(spark, [(1, 5.0, 5.0), (2, None, 1.0)]), table(spark, [(7, 90.0, 50.0), (8, 1.0, 1.0), (9, 1.0, None)])
    got = nearest.k_nearest(queries, points, PLANE, 5).collect()
    assert [(r.idx, r["rank"], r.q_idx) for r in sorted(got)] == [(1, 1, 8), (1, 2, 7)]
    assert nearest.k_nearest(queries, points.limit(0), PLANE, 2).collect() == [] == nearest.within(queries.limit(0), points, PLANE, 9.0).collect()
    with pytest.raises(ValueError):
        nearest.k_nearest(queries, points, PLANE, 0)


def test_a_search_looks_at_few_leaves(spark):
    """A uniform cloud of 20,000 points has over 300 leaves; a query's leaf meets a few of them."""
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((20_000, 2)) * (100, 60))]
    own, tree = nearest._trees(table(spark, rows[:2000]), table(spark, rows), PLANE)
    assert tree.leaves.count() == 313 and len(tree.levels) == 3
    at = nearest._first(own, tree)
    for level in (1, 0):
        at = nearest._down(at.where("near <= 1"), tree, level)
    met = at.where("near <= 1").groupBy("q").count().agg(F.avg("count"), F.count("*")).first()
    assert met[1] == 32 and met[0] < 60


def test_wide_radius_join_clips_its_buckets(spark, clouds):
    queries, points = clouds
    got = space.radius_join(table(spark, queries), table(spark, points[:300]), PLANE, float("inf"))
    assert got.count() == len(queries) * 300
    want = sorted((q[0], p[0]) for q in queries for p in points[:300] if gap(PLANE, q, p) <= 40)
    got = space.radius_join(table(spark, queries), table(spark, points[:300]), PLANE, 40.0)
    assert sorted((r.idx, r.q_idx) for r in got.collect()) == want


def test_radius_join_does_not_gather_a_side(spark, clouds):
    """Tables of a few MB were broadcast through the driver, and met in the one task that read the other."""
    queries, points = clouds
    plan = space.radius_join(table(spark, queries), table(spark, points), PLANE, 4.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_discs_equal_single_tests():
    rng = np.random.default_rng(8)
    p, q, n = np.round(rng.random((700, 2)) * 20, 1), np.round(rng.random((90, 2)) * 20, 1), rng.integers(1, 9, 700).astype(float)
    got = nearest.discs(q, p, n, 3.0)
    near = np.sqrt((q[:, None, 0] - p[:, 0]) ** 2 + (q[:, None, 1] - p[:, 1]) ** 2) <= 3.0
    assert np.array_equal(got[0], near @ n)
    assert np.allclose(got[1], near @ (n * p[:, 0]), rtol=1e-12) and np.allclose(got[2], near @ (n * p[:, 1]), rtol=1e-12)


@pytest.mark.parametrize("spec", [PLANE, ROUND])
def test_nearest_within_a_radius_in_rounds(spark, spec):
    """Evenly spread points, many queries at one place, and some that find less than k."""
    rng = np.random.default_rng(9)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((400, 2)) * (50, 60))]
    queries = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((60, 2)) * (100, 60))] + [(100 + i, 20.0, 20.0) for i in range(40)]
    got = {(r.idx, r["rank"]): (r.q_idx, r.dist) for r in nearest.k_nearest(table(spark, queries), table(spark, points), spec, 3, 8.0).collect()}
    want = {(q[0], n + 1): (i, d) for q in queries for n, (d, i) in enumerate(sorted((gap(spec, q, p), p[0]) for p in points)[:3]) if d <= 8}
    assert got == want


@pytest.mark.parametrize("spec", [PLANE, ROUND])
def test_flock_sums_do_not_depend_on_how_boids_are_dealt(spark, spec):
    """Ways that cancel out leave rounding errors, whose direction is that of a unit vector: they were added in any order."""
    rng = np.random.default_rng(3)
    boids = [(i, float(x), float(y), float(i % 7 - 3), float(i % 5 - 2)) for i, (x, y) in enumerate(rng.random((500, 2)) * (100, 60))]
    df = spark.createDataFrame(boids, "idx long, px double, py double, vx double, vy double")
    one, many = ({tuple(r) for r in space.flock_sums(df.repartition(n), spec, 12.0).collect()} for n in (1, 7))
    assert one == many and len(one) == 500
    got = {r[0]: r for r in one}
    for b in boids[:40]:
        near = [p for p in boids if p[0] != b[0] and gap(spec, b, p) <= 12]
        assert got[b[0]][3] == sum(p[3] for p in near) and got[b[0]][4] == sum(p[4] for p in near)
