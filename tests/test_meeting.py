"""Pairs and sums over neighbours, tile by tile, against plain loops."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agentframe.operators import meeting, space
from agentframe.operators.space import SpaceSpec
from agentframe.plans import registry
from tests.test_nearest import PLANE, ROUND, cloud, gap, table


@pytest.mark.parametrize(("spec", "radius"), [(ROUND, 7.0), (PLANE, 7.0), (ROUND, 26.0), (ROUND, float("inf")), (PLANE, 0.0)])
def test_pairs_of_crowded_tiles_in_blocks(spark, monkeypatch, spec, radius):
    """A third of all points at one place, in blocks and runs of a few points."""
    for name, value in (("BLOCK", 150), ("RUN", 7), ("TESTS", 500), ("BATCH", 90)):
        monkeypatch.setattr(meeting, name, value)
    queries, points = cloud(1, 120), cloud(2, 400)
    got = [(r.idx, r.q_idx, r.dist) for r in meeting.pairs_within(table(spark, queries), table(spark, points), spec, radius).collect()]
    assert sorted(got) == sorted((q[0], p[0], gap(spec, q, p)) for q in queries for p in points if gap(spec, q, p) <= radius)


def test_lists_of_pairs_are_bounded(monkeypatch):
    """Workers hold no table of all pairs."""
    for name, value in (("RUN", 8), ("TESTS", 256), ("BATCH", 64)):
        monkeypatch.setattr(meeting, name, value)
    rows = cloud(3, 500)
    t = pa.table({"idx": [r[0] for r in rows], "px": [r[1] for r in rows], "py": [r[2] for r in rows], "gx": [r[1] for r in rows], "gy": [r[2] for r in rows]})
    batches = list(meeting._all_pairs(t, t, PLANE, 20.0))
    held = [len(b.column(c).flatten()) for b in batches for c in ("idx", "q_idx", "dist")]
    assert len(batches) > 100 and max(held) <= 64 + 16


@pytest.mark.parametrize("name", ["radius_join", "radius_join_torus", "radius_pairs_any"])
def test_pair_queries_exchange_points_not_candidates(spark, name):
    """Each point was sent to nine buckets or more, or down a tree, and sorted there; now to the tiles in reach."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan


def test_few_points_travel(spark):
    """Tiles grow no narrower than the radius, and hold many points: here few are seen by a second tile."""
    rng = np.random.default_rng(5)
    df = table(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((3000, 2)) * 1000)])
    sent = meeting.met(df, df, SpaceSpec(1000.0, 1000.0, 10.0), 8.0, lambda a, b: iter([pa.RecordBatch.from_pydict({"own": [len(a)], "seen": [len(b)]})]), "own long, seen long").agg(F.sum("own"), F.sum("seen")).first()
    assert sent[0] == 3000 and sent[1] < 1.2 * 3000


@pytest.mark.parametrize(("spec", "radius"), [(ROUND, 9.0), (PLANE, 9.0), (ROUND, 30.0), (PLANE, float("inf"))])
def test_flock_sums_equal_a_plain_loop(spark, monkeypatch, spec, radius):
    """Also of boids at one place, which feel each other's velocities, and in blocks."""
    monkeypatch.setattr(meeting, "BLOCK", 150)
    monkeypatch.setattr(meeting, "SEEN", 60)
    boids = [(*b, float(b[0] % 7 - 3), float(b[0] % 5 - 2)) for b in cloud(4, 400)]
    df = spark.createDataFrame(boids, "idx long, px double, py double, vx double, vy double").repartition(5)
    got = {r[0]: r[1:] for r in space.flock_sums(df, spec, radius).collect()}
    assert len(got) == 400
    for b in boids:
        want = np.zeros(6)
        for o in boids:
            if o[0] != b[0] and gap(spec, b, o) <= radius:
                to = [o[1] - b[1], o[2] - b[2]]
                to = [d - n * np.sign(d) if spec.torus and abs(d) > n / 2 else d for d, n in zip(to, (100, 60), strict=True)]
                far = max(np.hypot(*to), 0.01)
                want += [-to[0] / far, -to[1] / far, o[3], o[4], *to]
        assert np.allclose(got[b[0]], want, rtol=1e-9, atol=1e-8) and got[b[0]][2:4] == tuple(want[2:4])


def test_flocking_counts_alone(spark):
    """A count of the steps' rows failed: the columns of one side were pruned away."""
    assert registry.QUERIES["model_boids"](spark, "/root/testdata/sf0.001").count() == registry.QUERIES["boids_step"](spark, "/root/testdata/sf0.001").count() == 150
