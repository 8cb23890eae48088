"""Behaviour that the SQL comparison cannot show."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.functions.chacha import Stream
from agentframe.functions.statistics import chi2_tail, signed_rank_p
from agentframe.operators import agents, batch, collect, design, graph, grid, models, populations, space
from agentframe.sources import raster, tables


def test_mix64_matches_plain_integers(spark):
    rows = spark.range(0, 10**15, 10**13).select("id", rng.mix64(F.col("id")).alias("h")).collect()
    assert all(rng.signed(rng._python_mix64(r.id)) == r.h for r in rows)


def test_exact_stream_reproduces_published_draws():
    # Published draws.
    draw = Stream(1)
    assert [draw.below(100) for _ in range(8)] == [40, 8, 59, 21, 28, 71, 46, 15]
    items = list(range(10))
    Stream(5).shuffle(items)
    assert items == [0, 4, 5, 3, 1, 9, 7, 8, 6, 2]
    draw = Stream(7)
    edges = [(a, b) for a in range(10) for b in range(a + 1, 10) if draw.chance(0.3)]
    assert edges == [(0, 1), (0, 2), (0, 7), (1, 3), (1, 6), (2, 3), (2, 5), (2, 8), (2, 9), (3, 4), (3, 7), (3, 8), (5, 7), (5, 8), (8, 9)]


def test_probability_outside_its_range_is_an_error(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(rng.bernoulli(rng.mix64(F.col("id")), F.lit(1.5))).collect()


@pytest.mark.parametrize("torus,kind,radius,count", [(False, grid.MOORE, 2, 24), (False, grid.VON_NEUMANN, 2, 12)])
def test_neighbour_counts(spark, torus, kind, radius, count):
    spec = grid.GridSpec(11, 11, torus)
    cell = spark.createDataFrame([(5, 5)], "x int, y int")
    assert grid.neighbour_positions_within(cell, spec, kind, radius).count() == count


def test_torus_neighbours_come_once_within_and_twice_at_width_two(spark):
    corner = spark.createDataFrame([(0, 0)], "x int, y int")
    assert grid.neighbour_positions_within(corner, grid.GridSpec(5, 5, True), grid.MOORE, 10).select("nx", "ny").distinct().count() == 24
    assert grid.neighbour_positions_within(corner, grid.GridSpec(5, 5, True), grid.MOORE, 10).count() == 24
    assert grid.neighbour_positions_within(corner, grid.GridSpec(5, 5, True), grid.VON_NEUMANN, 3).count() == 20
    assert grid.neighbour_positions(corner, grid.GridSpec(1, 1, True)).count() == 0
    assert grid.neighbour_positions(corner, grid.GridSpec(2, 5, True), grid.VON_NEUMANN).count() == 4


def test_diffusion_conserves_mass_and_keeps_clipped_shares(spark):
    cells = grid.from_fn(spark, grid.GridSpec(5, 5), v=F.when((F.col("x") == 0) & (F.col("y") == 0), 80.0).otherwise(0.0))
    out = {(r.x, r.y): r.v for r in grid.diffuse(cells, grid.GridSpec(5, 5), "v", 0.5).collect()}
    assert out[0, 0] == 65 and out[1, 1] == 5 and math.isclose(sum(out.values()), 80)
    with pytest.raises(ValueError):
        grid.diffuse(cells, grid.GridSpec(5, 5), "v", 1.5)
    with pytest.raises(ValueError):
        grid.GridSpec(0, 3)


def test_radius_join_equals_brute_force(spark):
    rand = np.random.default_rng(4)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rand.random((120, 2)) * 25)]
    df = spark.createDataFrame(pts, "idx int, px double, py double")
    for torus in (False, True):
        for radius in (3.0, 100.0):
            spec = space.SpaceSpec(25.0, 25.0, 5.0, torus)
            got = {(r.idx, r.q_idx) for r in space.radius_join(df, df, spec, radius).collect()}
            gap = lambda a, b: min(abs(a - b), 25 - abs(a - b)) if torus else abs(a - b)  # noqa: B023, E731
            assert got == {(i, j) for i, x, y in pts for j, u, v in pts if math.hypot(gap(x, u), gap(y, v)) <= radius}
            assert space.radius_join(df, df, spec, radius).count() == len(got)


def test_wrap_folds_the_upper_edge_to_zero(spark):
    spec = space.SpaceSpec(100.0, 100.0, 10.0, True)
    x, _ = space.wrap(spec, F.col("px"), F.col("px"))
    got = [r.x for r in spark.createDataFrame([(-1e-15,), (100.0,), (-3.0,)], "px double").select(x.alias("x")).collect()]
    assert got == [0.0, 0.0, 97.0]


def test_life_blinker_and_glider(spark):
    spec = grid.GridSpec(5, 5)
    alive = {(2, 1), (2, 2), (2, 3)}
    board = spark.createDataFrame([(x, y, (x, y) in alive) for x in range(5) for y in range(5)], "x int, y int, alive boolean")
    step = lambda b, _: models.life_step(b, spec)
    once = {(r.x, r.y) for r in models.run(board, step, 1).where("alive").collect()}
    twice = {(r.x, r.y) for r in models.run(board, step, 2).where("alive").collect()}
    assert once == {(1, 2), (2, 2), (3, 2)} and twice == alive


def test_graph_generators(spark):
    seeds = spark.createDataFrame([(s,) for s in range(3)], "seed long")
    small = graph.watts_strogatz(spark, 50, 3, 0.4, seeds).toPandas()
    for _, g in small.groupby("seed"):
        pairs = {tuple(sorted(p)) for p in g[["src", "dst"]].values.tolist()}
        assert len(g) == len(pairs) == 150 and (g.src != g.dst).all()
    ba = graph.barabasi_albert(spark, 300, 2, seeds).toPandas()
    degree = ba[ba.seed == 0][["src", "dst"]].stack().value_counts()
    assert 540 < len(ba[ba.seed == 0]) <= 2 + 2 * 297 and degree.max() > 4 * degree.mean()
    assert len(ba) == len(ba.drop_duplicates()) and (ba.src > ba.dst)[ba.src > 2].all()


def test_slots_are_reused_last_freed_first(spark):
    there = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 0, 1)], "idx long, gen int, w long")
    dead = spark.createDataFrame([(1, 0, 1), (3, 0, 2), (3, 0, 2)], "idx long, gen int, seq long")
    born = spark.createDataFrame([(10, 7), (11, 8), (12, 9)], "seq long, w long")
    got = sorted(map(tuple, agents.demography(there, dead, born, 3).collect()))
    assert got == [(0, 0, 1), (1, 1, 8), (2, 0, 1), (3, 1, 7), (4, 0, 9)]


def test_sobol_points_are_a_net(spark):
    for k in range(10):
        u = [r.u for r in spark.range(64).select(design.sobol_point(F.col("id"), k).alias("u")).collect()]
        assert sorted(int(v * 64) for v in u) == list(range(64))


def test_ishigami_indices(spark):
    base = design.sobol_design(spark, 3, 1024)
    ranged = base.select("row", *[(-math.pi + 2 * math.pi * F.col(c)).alias(c) for c in base.columns if c != "row"])
    y = F.sin("x0") + 7 * F.pow(F.sin("x1"), F.lit(2)) + 0.1 * F.pow("x2", F.lit(4)) * F.sin("x0")
    got = {r.param: r for r in design.sobol_indices(design.saltelli(ranged, 3).select("row", "block", y.alias("y")), 3).collect()}
    for k, (s1, st) in enumerate([(0.3139, 0.5574), (0.4424, 0.4424), (0.0, 0.2436)]):
        assert abs(got[k].s1 - s1) < 0.05 and abs(got[k].st - st) < 0.05


def test_latin_hypercube_has_one_point_a_stratum(spark):
    rows = design.latin_hypercube(spark, [(0.0, 1.0), (0.0, 1.0)], 20, 3).collect()
    for dim in (0, 1):
        assert sorted(int(r.value * 20) for r in rows if r.dim == dim) == list(range(20))


def test_populations_keep_their_promises(spark):
    spec = grid.GridSpec(6, 6, True)
    cells = grid.from_fn(spark, spec, cap=F.lit(4), sugar=F.lit(4))
    rows = [(i, i % 6, i // 6, i % 2) for i in range(24)]
    crowd = spark.createDataFrame(rows, "idx long, x int, y int, grp int")
    moved = populations.schelling_step(crowd, cells, spec, 0, 1, F.lit(0.9)).collect()
    assert sorted(r.idx for r in moved) == list(range(24)) and len({(r.x, r.y) for r in moved}) == 24
    assert any((r.x, r.y) != rows[r.idx][1:3] for r in moved)
    eaters = crowd.select("idx", "x", "y", F.lit(2).alias("vision"), F.lit(1).alias("metabolism"), F.lit(1).alias("wealth"))
    fed, left = populations.sugar_step(eaters, cells, spec, F.lit(1))
    fed = fed.collect()
    assert len({(r.x, r.y) for r in fed}) == len(fed) == 24 and all(r.wealth == 4 for r in fed)
    assert left.where("sugar = 1").count() == 24
    wolves = spark.createDataFrame([(100, 2, 2)], "idx long, x int, y int")
    grazers, after = populations.hunt_step(crowd.select("idx", "x", "y"), wolves, spec, 0, 3)
    assert 23 <= grazers.count() <= 24 and after.count() == 1


def test_run_until_finished_with_hooks_and_series(spark):
    start = spark.createDataFrame([(0, 0)], "idx long, v long")
    step = lambda s, k: s.withColumn("v", F.col("v") + 1)
    done = models.run(start, step, 50, finished=lambda s: F.max("v") >= 4, after=lambda s, k: s.withColumn("last", F.lit(k)))
    assert tuple(done.first()) == (0, 4, 3)
    series = models.run_collected(start, step, 6, {"top": F.max("v")}, stride=3)
    assert sorted(tuple(r) for r in series.collect()) == [(0, 0), (3, 3), (6, 6)]
    with pytest.raises(ValueError):
        models.run_collected(start, step, 1, {}, stride=0)


def test_model_evaluated_over_a_design(spark):
    points = design.saltelli(design.sobol_design(spark, 2, 256), 2)
    got = {r.param: r.s1 for r in design.evaluate_all(points, lambda p: p.withColumn("y", 3 * F.col("x0") + F.col("x1")), 2).collect()}
    assert abs(got[0] - 0.9) < 0.05 and abs(got[1] - 0.1) < 0.05


def test_sobol_uses_all_bits_and_read_tables(spark, tmp_path):
    far = [r.u for r in spark.createDataFrame([(1,), (1 + (1 << 25),)], "id long").select(design.sobol_point(F.col("id"), 3).alias("u")).collect()]
    assert far[0] != far[1]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(1 << 31,)], "id long").select(design.sobol_point(F.col("id"), 0)).collect()
    lines = ["d s a m_i"] + [f"{k + 2} {s} {a} {' '.join(map(str, m))}" for k, (s, a, m) in enumerate(design.DIRECTIONS)]
    (tmp_path / "table").write_text("\n".join(lines))
    assert design.read_directions(str(tmp_path / "table")) == design.DIRECTIONS
    with pytest.raises(ValueError):
        design.sobol_design(spark, 6, 8)


def test_torus_with_a_cut_bucket_reaches_across_its_edge(spark):
    rand = np.random.default_rng(8)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rand.random((150, 2)) * 23)]
    df = spark.createDataFrame(pts, "idx int, px double, py double")
    gap = lambda a, b: min(abs(a - b), 23 - abs(a - b))
    for radius in (5.0, 6.0, 9.0):
        got = sorted((r.idx, r.q_idx) for r in space.radius_join(df, df, space.SpaceSpec(23.0, 23.0, 5.0, True), radius).collect())
        assert got == sorted((i, j) for i, x, y in pts for j, u, v in pts if math.hypot(gap(x, u), gap(y, v)) <= radius)


def test_line_numbers_and_sinks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        (tmp_path / "p.csv").write_text("".join(f"{i},{i / 2}\n" for i in range(300)))
        rows = tables.read_parameters(spark, str(tmp_path / "p.csv"), ["a", "b"])
        assert rows.rdd.getNumPartitions() > 1 and all(r.idx == r.a for r in rows.collect()) and rows.count() == 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    tables.write_losses(rows.select("idx", (F.col("a") / 3).alias("loss")), str(tmp_path / "loss"))
    lines = [line for f in sorted((tmp_path / "loss").glob("part*")) for line in f.read_text().split()]
    assert lines == [f"{i / 3:.6f}" for i in range(300)]
    runs = spark.createDataFrame([("de", 0, 0.5, 10, 1.0), ("ga", 1, 0.7, 20, 2.0)], "method string, run int, best double, evals int, p double")
    tables.write_results(runs, str(tmp_path / "runs"))
    tables.write_best(runs, ["p"], str(tmp_path / "best"))
    assert spark.read.json(str(tmp_path / "best")).first().p == 2.0 and spark.read.csv(str(tmp_path / "runs"), header=True).count() == 2
    mark = spark.createDataFrame([(1, 0), (1, 0), (2, 2)], "x int, y int")
    raster.write_footprint(mark, str(tmp_path / "mark"), 3, 3)
    assert b"".join(f.read_bytes() for f in sorted((tmp_path / "mark" / "footprint").iterdir())) == bytes([0, 1, 0, 0, 0, 0, 0, 0, 1])
    assert [tuple(r) for r in raster.window(mark.distinct(), 1, 1, 2, 2).collect()] == [(1, 1)]


def test_optimisers_climb(spark):
    value = lambda x: x.select("id", (-F.pow(F.get("x", 0) - 0.5, F.lit(2))).alias("value"))
    for method in ("de", "ga", "pso", "gwo", "sa"):
        best, top = batch.maximise(spark, value, [(-2.0, 2.0)], 5, 12, 1, method)
        assert top > -0.05 and abs(best[0] - 0.5) < 0.3


def test_tail_probabilities():
    assert abs(chi2_tail(14.32, 4) - 0.00634) < 1e-4 and abs(chi2_tail(3.841, 1) - 0.05) < 1e-3
    assert signed_rank_p(0, 6) == 2 / 64


def test_rasters_series_and_checkpoints_round_trip(spark, tmp_path):
    values = np.arange(12, dtype="<f4")
    (tmp_path / "dem.f32").write_bytes(values.tobytes())
    (tmp_path / "slope.f32").write_bytes((values * 2).tobytes())
    (tmp_path / "meta.json").write_text('{"width": 4, "height": 3}')
    got = raster.read_stack(spark, str(tmp_path), ["dem", "slope"]).collect()
    assert {(r.x, r.y): (r.dem, r.slope) for r in got} == {(i % 4, i // 4): (i, 2 * i) for i in range(12)}
    (tmp_path / "meta.json").write_text('{"width": 4, "height": 3, "pixel_size": 30.0, "window": {"row_start": 2, "row_end": 5, "col_start": 1, "col_end": 5}}')
    placed = {(r.x, r.y): (r.px, r.py) for r in raster.read_window(spark, str(tmp_path), ["dem"]).collect()}
    assert placed[0, 0] == (45.0, 75.0) and placed[3, 2] == (135.0, 135.0)
    state = spark.range(3).withColumn("v", F.col("id") * 2)
    tables.save_checkpoint({"agents": state}, {"seed": 4, "steps": 7}, f"{tmp_path}/cp")
    loaded, meta = tables.load_checkpoint(spark, ["agents"], f"{tmp_path}/cp")
    assert meta == {"seed": 4, "steps": 7} and sorted(map(tuple, loaded["agents"].collect())) == sorted(map(tuple, state.collect()))


def test_collectors(spark):
    state = spark.createDataFrame([(0, 1, 5.0), (0, 2, 7.0), (1, 1, 1.0)], "step long, idx long, v double")
    assert collect.panel(state, ["step", "idx"], {}).count() == 0
    assert collect.gini(spark.createDataFrame([("a", 0), ("a", 0)], "g string, w long"), "g", "w").first().gini == 0
    with pytest.raises(ValueError):
        collect.every(state, 0)


def test_one_loop_with_hooks_stop_and_series(spark):
    start = spark.createDataFrame([(1, 5), (2, 9)], "idx long, v long")
    state, series = models.simulate(start, lambda s, k: s.withColumn("v", F.col("v") + 1), 9, finished=lambda s: F.max("v") >= 16, before=lambda s, k: s.withColumn("v", F.col("v") + k), reporters={"top": F.max("v")}, by=("idx",), stride=3)
    assert {r.idx: r.v for r in state.collect()} == {1: 15, 2: 19}
    assert sorted(map(tuple, series.collect())) == [(1, 0, 5), (1, 3, 11), (1, 4, 15), (2, 0, 9), (2, 3, 15), (2, 4, 19)]
    assert models.simulate(start, lambda s, k: s, 3)[1] is None
    with pytest.raises(ValueError):
        models.simulate(start, lambda s, k: s, 3, stride=0)


def test_stale_ids_are_errors(spark):
    there = spark.createDataFrame([(1, 0, 2.0, 3.0), (2, 4, 5.0, 6.0)], "idx long, gen int, px double, py double")
    ids = spark.createDataFrame([(1, 0), (2, 4), (2, 3), (9, 0)], "idx long, gen int")
    got = {(r.idx, r.gen): (r.px, r.stale) for r in space.positions(there, ids, strict=False).collect()}
    assert got == {(1, 0): (2.0, False), (2, 4): (5.0, False), (2, 3): (None, True), (9, 0): (None, True)}
    assert space.positions(there, ids.limit(2)).count() == 2
    with pytest.raises(PySparkException, match="stale id"):
        space.positions(there, ids).collect()


def test_stencils_and_sir_steps_are_dealt_out(spark):
    """Rasters of a few MB were broadcast through the driver, and a stencil's rows were made, and sorted, in the one task that read the raster."""
    spec = grid.GridSpec(20, 30, True)
    cells = grid.from_fn(spark, spec, v=F.col("x") * 1.5, status=F.when(F.col("x") == 3, "I").otherwise("S"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    best = plan(grid.best_in_window(cells.select("x", "y"), cells, grid.GridSpec(20, 30), 2, -F.col("n_v"), ["x", "y"]))
    assert "BroadcastHashJoin" not in best and "div 32" in best
    step = plan(models.sir_step(cells, spec, 0, 3, 0.2, 0.1))
    assert "SortAggregate" not in step and "div 32" in step


def test_like_neighbours_are_counted_without_a_join(spark):
    """Agents anywhere, also beyond the raster of other tables; null is like none, an agent alone has none around."""
    cells = {(0, 0): "a", (1, 0): "a", (1, 1): "b", (0, 1): None, (2, 0): None, (19, 5): "a", (0, 6): "a", (4, 90_000): "b", (5, 90_001): "b"}
    df = spark.createDataFrame([(x, y, k) for (x, y), k in cells.items()], "x int, y int, kind string")
    out = grid.like_neighbours(df, grid.GridSpec(20, 1 << 30), "kind")
    want = {}
    for (x, y), k in cells.items():
        near = [cells[x + i, y + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (x + i, y + j) in cells]
        want[x, y] = (len(near), sum(k is not None and n == k for n in near))
    assert {(r.x, r.y): (r.occ, r.same) for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_lowest_or_flat_descends_or_needs_speed(spark):
    """The lowest cell of the window was taken also where it lies above the cell itself, without slope or speed."""
    heights = [5.0, 5.5, 9.0, 4.0, 4.0, 60.0, 61.0]  # cells 0, 3 and 4: no way down
    cells = spark.createDataFrame([(x, 0, v, x != 3) for x, v in enumerate(heights)], "x int, y int, v double, fast boolean")
    out = grid.lowest_or_flat(cells, cells.select("x", "y", "v"), grid.GridSpec(7, 1), 2, 30.0, moving=F.col("fast")).collect()
    got = {r.x: (r.bx, r.flat, round(r.slope, 6)) for r in out}
    assert got == {0: (1, True, -0.016667), 1: (3, False, 0.025), 2: (3, False, 0.166667), 4: (3, True, 0.0), 5: (3, False, 0.933333), 6: (4, False, 0.95)}
