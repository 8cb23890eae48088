"""SIR rasters in bands against the step that scatters cell by cell."""

import pytest
from pyspark.sql import functions as F

from agentframe.operators import epidemics, grid, models
from agentframe.plans import registry


@pytest.mark.parametrize(("width", "height", "steps", "cells"), [(7, 23, 4, 30), (7, 9, 4, 30), (5, 31, 2, 80), (6, 5, 8, 1000)])
def test_bands_equal_single_steps(spark, monkeypatch, width, height, steps, cells):
    monkeypatch.setattr(epidemics, "STEPS", steps)
    monkeypatch.setattr(epidemics, "CELLS", cells)
    spec = grid.GridSpec(width, height, True)
    board = grid.from_fn(spark, spec, status=F.when((F.col("x") * 5 + F.col("y") * 3) % 17 == 0, "I").otherwise("S"))
    runs = spark.createDataFrame([(0, 5), (1, 6)], "run long, seed long")
    got = sorted(map(tuple, epidemics.sir_to_the_end(board, runs, spec, 31, 0.3, 0.5, ("seed",)).collect()))
    agent = F.col("run") * (width * height) + models.cell_id(spec)
    state, want, ended = board.crossJoin(runs).localCheckpoint(), [], set()
    for k in range(1 + max(r[1] for r in got)):
        for r in state.groupBy("run", "seed").agg(*[F.count_if(F.col("status") == c).alias(c) for c in "SIR"]).collect():
            if r.run not in ended:
                want.append((r.seed, k, r.S, r.I, r.R))
            ended |= {r.run} if r.I == 0 else set()
        state = models.sir_step(state, spec, k, 31, 0.3, 0.5, ("run", "seed"), agent).localCheckpoint()
    assert got == sorted(want) and ended == {0, 1}


def test_model_sir_runs_until_nobody_is_infected(spark):
    """It ended after three steps."""
    rows = registry.QUERIES["model_sir"](spark, "/root/testdata/sf0.001").collect()
    last = {s: max(r.step for r in rows if r.seed == s) for s in range(4)}
    assert all((r.i == 0) == (r.step == last[r.seed]) and r.s + r.i + r.r == 200 for r in rows) and min(last.values()) > 30


def test_a_run_that_cannot_end_is_an_error(spark):
    spec = grid.GridSpec(3, 3, True)
    with pytest.raises(ValueError):
        epidemics.sir_to_the_end(grid.from_fn(spark, spec, status=F.lit("I")), spark.range(1).withColumnRenamed("id", "run"), spec, 1, 0.1, 0.0)
