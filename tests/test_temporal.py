"""Joins on time against plain loops, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from agentframe.operators import temporal


def sides(seed=1):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(400)])) for i in range(900)]
    right = [(i, key(), rng.randrange(400), rng.random()) for i in range(150)] + [(999, "a", None, 0.5)]
    return left, right


@pytest.mark.parametrize(("strictly", "most"), [(False, None), (True, None), (False, 3.0)])
def test_latest_earlier_row(spark, strictly, most):
    left, right = sides()
    lf = spark.createDataFrame(left, "id long, k string, t long").repartition(5)
    rf = spark.createDataFrame(right, "rid long, k string, t long, v double").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = temporal.asof_join(lf, rf, ["k"], "t", ["rid", "v"], ties=["rid"], most=most, strictly=strictly)
    assert got.columns == ["id", "k", "t", "r_t", "rid", "v"]
    rows = {r.id: (r.r_t, r.rid) for r in got.collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == len(left)
    for i, k, t in left:
        fits = [(x[2], x[0]) for x in right if x[1] == k and None not in (t, x[2]) and (x[2] < t if strictly else x[2] <= t)]
        best = max(fits, default=(None, None))
        assert rows[i] == ((None, None) if best[0] is None or (most is not None and t - best[0] > most) else best)


def test_no_rows(spark):
    lf, rf = spark.createDataFrame([(1, "a", 5)], "id long, k string, t long"), spark.createDataFrame([], "k string, t long, v double")
    assert [tuple(r) for r in temporal.asof_join(lf, rf, ["k"], "t", ["v"]).collect()] == [(1, "a", 5, None, None)]
    assert temporal.asof_join(lf.limit(0), rf, ["k"], "t", ["v"]).collect() == []


def test_intervals_of_all_lengths(spark):
    rng = random.Random(7)
    spans = [(i, rng.choice(["x", "y", None]), s := rng.uniform(-50, 1000), s + 2 ** rng.uniform(-6, 9)) for i in range(120)] + [(900, "x", 5.0, 5.0), (901, "x", 9.0, 3.0)]
    moments = [(i, rng.choice(["x", "y", None]), rng.choice([None, rng.uniform(-100, 1500), float(rng.randrange(1000))])) for i in range(500)] + [(990, spans[0][1], spans[0][2]), (991, spans[0][1], spans[0][3])]
    got = temporal.interval_join(spark.createDataFrame(moments, "id long, k string, t double"), spark.createDataFrame(spans, "s long, k string, a double, b double"), ["k"], "t", "a", "b")
    assert got.columns == ["id", "k", "t", "s", "a", "b"]
    assert sorted((r.id, r.s) for r in got.collect()) == sorted((i, s) for i, k, t in moments for s, q, a, b in spans if k == q and t is not None and a <= t < b)
    assert got.where(F.col("s") >= 900).count() == 0
