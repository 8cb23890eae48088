"""Tiled stencils against plain loops, on grids whose sizes are no multiple of a side."""

import math

import numpy as np
import pytest

from agentframe.operators import tiles
from agentframe.operators.grid import MOORE, VON_NEUMANN, GridSpec


def raster(spark, spec, seed=1, holes=0.1):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 12, (spec.height, spec.width)).astype(float)
    a[rng.random(a.shape) < holes] = np.nan
    rows = [(x, y, None if np.isnan(a[y, x]) else float(a[y, x])) for y in range(spec.height) for x in range(spec.width) if not (np.isnan(a[y, x]) and (x + y) % 2)]
    return a, spark.createDataFrame(rows, "x int, y int, v double").repartition(3)


def window(a, spec, x, y, r):
    """The window's cells (order, x, y, value, is the middle), each once."""
    reach = tiles.Reach.of(spec, r)
    for dx in range(reach.x0, reach.x1 + 1):
        for dy in range(reach.y0, reach.y1 + 1):
            nx, ny = x + dx, y + dy
            if spec.torus:
                nx, ny = nx % spec.width, ny % spec.height
            elif not (0 <= nx < spec.width and 0 <= ny < spec.height):
                continue
            if not np.isnan(a[ny, nx]):
                yield (dx, dy), nx, ny, a[ny, nx], (dx, dy) == (0, 0)


CASES = [(GridSpec(13, 9), 4, 2), (GridSpec(13, 9), 4, 11), (GridSpec(7, 20), 5, 6), (GridSpec(13, 9, True), 4, 3), (GridSpec(7, 20, True), 8, 5), (GridSpec(5, 6, True), 2, 9), (GridSpec(3, 3), 8, 0)]


@pytest.mark.parametrize(("spec", "side", "r"), CASES)
def test_windows_match_loops(spark, spec, side, r):
    a, cells = raster(spark, spec)
    tiling = tiles.Tiling(spec, side)
    cut = tiles.cut(cells, tiling, "v")
    stats = {(p.x, p.y): p for p in tiles.cells_of(tiles.window_stats(cut, tiling, r, "v"), tiling).collect()}
    best = {(p.x, p.y): (p.bx, p.by, p.best) for p in tiles.cells_of(tiles.best_in_window(cut, tiling, r, "v"), tiling).collect()}
    assert len(stats) == (~np.isnan(a)).sum()
    for (x, y), p in stats.items():
        seen = list(window(a, spec, x, y, r))
        values = [s[3] for s in seen]
        assert (p.n, p.sum, p.least, p.most) == (len(values), sum(values), min(values), max(values)) and math.isclose(p.mean, sum(values) / len(values))
        others = [s for s in seen if not s[4]]
        top = max(others, key=lambda s: (s[3], -s[0][0], -s[0][1]), default=None)
        assert best.get((x, y)) == (None if top is None else (top[1], top[2], top[3]))
        assert spec.torus is False or len({s[1:3] for s in seen}) == len(seen)


@pytest.mark.parametrize(("spec", "side", "r"), CASES[:4])
def test_way_down_matches_loops(spark, spec, side, r):
    a, cells = raster(spark, spec)
    tiling = tiles.Tiling(spec, side)
    got = {(p.x, p.y): (p.bx, p.by, p.flat) for p in tiles.cells_of(tiles.lowest_or_flat(tiles.cut(cells, tiling, "v"), tiling, r, "v", 30.0), tiling).collect()}
    for y, x in zip(*np.where(~np.isnan(a)), strict=True):
        seen = [s for s in window(a, spec, x, y, r) if not s[4]]
        down = min((s for s in seen if s[3] < a[y, x]), key=lambda s: (s[3], s[0]), default=None)
        flat = min((s for s in seen if (a[y, x] - s[3]) / (math.hypot(*s[0]) * 30) >= -0.05), key=lambda s: (abs(s[3] - a[y, x]), s[0]), default=None)
        one = down or flat
        assert got.get((x, y)) == (None if one is None else (one[1], one[2], float(down is None)))


@pytest.mark.parametrize("kind", [MOORE, VON_NEUMANN])
@pytest.mark.parametrize("spec", [GridSpec(13, 9), GridSpec(8, 11, True)])
def test_steps_of_diffusion_match_single_steps(spark, spec, kind):
    a, cells = raster(spark, spec, holes=0)
    tiling = tiles.Tiling(spec, 4)
    got = {(p.x, p.y): p.v for p in tiles.cells_of(tiles.diffuse(tiles.cut(cells, tiling, "v"), tiling, "v", 0.6, 5, kind), tiling).collect()}
    shift = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0) and (kind == MOORE or 0 in (dx, dy))]
    for _ in range(5):
        b = a.copy()
        for y in range(spec.height):
            for x in range(spec.width):
                for dx, dy in shift:
                    nx, ny = (x + dx) % spec.width if spec.torus else x + dx, (y + dy) % spec.height if spec.torus else y + dy
                    if 0 <= nx < spec.width and 0 <= ny < spec.height:
                        b[ny, nx] += a[y, x] * 0.6 / len(shift)
                        b[y, x] -= a[y, x] * 0.6 / len(shift)
        a = b
    assert all(math.isclose(got[x, y], a[y, x], abs_tol=1e-9) for y in range(spec.height) for x in range(spec.width))


def test_disc_matches_loops(spark):
    for spec in (GridSpec(30, 17), GridSpec(30, 17, True)):
        marks = [(3, 4), (28, 16), (15, 0)]
        cells = spark.createDataFrame([(x, y, 1.0) for x, y in marks], "x int, y int, v double")
        tiling = tiles.Tiling(spec, 8)
        got = {(p.x, p.y) for p in tiles.cells_of(tiles.disc(tiles.cut(cells, tiling, "v"), tiling, 6, "v"), tiling).collect()}
        gap = lambda a, b, n: min(abs(a - b), n - abs(a - b)) if spec.torus else abs(a - b)  # noqa: E731, B023
        assert got == {(x, y) for x in range(30) for y in range(17) if any(gap(x, mx, 30) ** 2 + gap(y, my, 17) ** 2 < 36 for mx, my in marks)}


def test_rows_exchanged_do_not_depend_on_the_radius():
    tiling = tiles.Tiling(GridSpec(1000, 1000), 100)
    sent = lambda r: sum(len(tiling.reached(x, 1000, r, r)) * len(tiling.reached(y, 1000, r, r)) for x in range(10) for y in range(10))
    assert sent(1) == sent(10) == sent(100) == 28 * 28


def test_errors_and_empty_rasters(spark):
    tiling = tiles.Tiling(GridSpec(5, 5, True), 2)
    none = tiles.cut(spark.createDataFrame([], "x int, y int, v double"), tiling, "v")
    assert tiles.cells_of(tiles.window_stats(none, tiling, 1, "v"), tiling).collect() == []
    for wrong in (lambda: tiles.diffuse(none, tiling, "v", 2.0), lambda: tiles.diffuse(none, tiling, "v", 0.1, 9), lambda: tiles.window_stats(none, tiling, -1, "v"), lambda: tiles.Tiling(GridSpec(1, 1), 0)):
        with pytest.raises(ValueError):
            wrong()
