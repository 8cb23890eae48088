"""Populations as tables: all methods climb, and nothing depends on the partitioning."""

import pytest
from pyspark.sql import functions as F

from agentframe.operators import optimise as o

BOUNDS = [(-2.0, 2.0), (0.0, 4.0)]


def bowl(tried):
    return tried.select(*o.KEYS, (-(F.pow(F.get("x", 0) - 0.5, F.lit(2)) + F.pow(F.get("x", 1) - 3, F.lit(2)))).alias("y"))


def test_all_methods_climb(spark):
    start = o.start(spark, list(o.METHODS), 2, 10, BOUNDS, 3, bowl)
    before = {(r.method, r.run): r.y for r in start.groupBy("method", "run").agg(F.max("y").alias("y")).collect()}
    got = o.run_grid(spark, bowl, list(o.METHODS), 2, BOUNDS, 4, 10, 3).collect()
    assert len(got) == 12 and {r.evals for r in got} == {14, 50}
    for r in got:
        assert r.best >= before[r.method, r.run] and r.best == pytest.approx(-((r.x[0] - 0.5) ** 2 + (r.x[1] - 3) ** 2))
        assert all(a <= v <= b for v, (a, b) in zip(r.x, BOUNDS, strict=True))
        assert r.method == "de_serial" or r.best > -0.6
    assert len({tuple(r.x) for r in got}) == 12


def test_partners_differ_and_one_individual_moves_at_a_time(spark):
    state = o.start(spark, ["de", "de_serial"], 1, 6, BOUNDS, 5, bowl)
    one = {tuple(r) for r in o.trials(state, 4, 9, BOUNDS, 5).select(*o.KEYS, "trial").collect() for r in [(r.method, r.i)]}
    assert one == {("de", k) for k in range(6)} | {("de_serial", 4)}
    rows = o.trials(state.repartition(5), 4, 9, BOUNDS, 5).orderBy(*o.KEYS).collect()
    assert rows == o.trials(state.coalesce(1), 4, 9, BOUNDS, 5).orderBy(*o.KEYS).collect()
    taken = spark.range(2000).select((F.col("id") % 7).alias("i"), (F.col("id") % 6).alias("r")).withColumn("r1", o._apart(F.col("r"), [F.col("i")])).withColumn("r2", o._apart(F.lit(4), [F.col("i"), F.col("r1")]))
    assert taken.where("r1 = i or r2 = i or r2 = r1 or r1 > 6 or r2 > 6").count() == 0


def test_robust_values_and_errors(spark):
    rows = spark.createDataFrame([("de", 0, 1, v) for v in (0.2, 0.4)], "method string, run long, i long, v double")
    assert o.robust(rows, "v", 0.5).first().y == pytest.approx(0.25)
    for wrong in (lambda: o.start(spark, ["none"], 1, 9, BOUNDS, 1, bowl), lambda: o.start(spark, ["de"], 1, 3, BOUNDS, 1, bowl)):
        with pytest.raises(ValueError):
            wrong()
