"""Raster queries over the part grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.operators import grid as g
from agentframe.operators.models import capacity_band
from agentframe.plans.declare import query
from agentframe.plans.fixtures import AGENTS, GRID, HEIGHT, POINTS, WIDTH, agents, grid, grid_spec, points, table
from agentframe.plans.random_plans import child_sql, u01

_OFF = lambda r, keep="TRUE": f"(SELECT CAST(a.i AS INT) AS dx, CAST(b.i AS INT) AS dy FROM range(-{r}, {r} + 1) AS a(i), range(-{r}, {r} + 1) AS b(i) WHERE (a.i <> 0 OR b.i <> 0) AND {keep})"
_CLIP = f"nx >= 0 AND ny >= 0 AND nx < {WIDTH} AND ny < {HEIGHT}"
_VN = "abs(a.i) + abs(b.i) <= 1"


def _near(offsets: str, torus: bool = False) -> str:
    if torus:
        wrap = lambda e, n: f"(({e}) % {n} + {n}) % {n}"
        return f"(SELECT * FROM (SELECT c.*, {wrap('x + dx', WIDTH)} AS nx, {wrap('y + dy', HEIGHT)} AS ny FROM {GRID} c, {offsets}) WHERE nx <> x OR ny <> y)"
    return f"(SELECT * FROM (SELECT c.*, x + dx AS nx, y + dy AS ny FROM {GRID} c, {offsets}) WHERE {_CLIP})"


def _neighbours(spark, sf_dir, kind, torus=False):
    return g.neighbour_positions(grid(spark, sf_dir), grid_spec(spark, sf_dir, torus), kind).select("x", "y", "nx", "ny")


@query(f"SELECT x, y, (x * 3 + y) AS v FROM (SELECT CAST(i % {WIDTH} AS INT) AS x, CAST(i // {WIDTH} AS INT) AS y FROM (SELECT unnest(range({WIDTH} * {HEIGHT})) AS i))")
def grid_from_fn(spark, sf_dir):
    return g.from_fn(spark, grid_spec(spark, sf_dir), v=F.col("x") * 3 + F.col("y"))


@query(f"SELECT p.id, p.x, p.y, c.v FROM (SELECT o_orderkey AS id, CAST(o_custkey % 25 AS INT) AS x, CAST(o_orderkey % 15 AS INT) AS y FROM orders) p LEFT JOIN {GRID} c USING (x, y)")
def grid_get(spark, sf_dir):
    places = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).cast("int").alias("x"), (F.col("o_orderkey") % 15).cast("int").alias("y"))
    return g.get(grid(spark, sf_dir).select("x", "y", "v"), places).select("id", "x", "y", "v")


@query(f"SELECT CASE WHEN x = 1 AND y = 2 THEN 3 WHEN x = 3 AND y = 4 THEN 1 ELSE x END AS x, CASE WHEN x = 1 AND y = 2 THEN 4 WHEN x = 3 AND y = 4 THEN 2 ELSE y END AS y, v FROM {GRID}")
def grid_swap(spark, sf_dir):
    return g.swap(grid(spark, sf_dir).select("x", "y", "v"), (1, 2), (3, 4))


@query(f"SELECT x, y, nx, ny FROM {_near(_OFF(1))}")
def grid_neighbors_moore(spark, sf_dir):
    return _neighbours(spark, sf_dir, g.MOORE)


@query(f"SELECT x, y, nx, ny FROM {_near(_OFF(1, _VN))}")
def grid_neighbors_vn(spark, sf_dir):
    return _neighbours(spark, sf_dir, g.VON_NEUMANN)


@query(f"SELECT x, y, nx, ny FROM {_near(_OFF(1), True)}")
def grid_neighbors_torus(spark, sf_dir):
    return _neighbours(spark, sf_dir, g.MOORE, True)


@query(f"SELECT x, y, nx, ny FROM {_near(_OFF(3))}")
def grid_neighbors_r_moore(spark, sf_dir):
    return g.neighbour_positions_within(grid(spark, sf_dir), grid_spec(spark, sf_dir), g.MOORE, 3).select("x", "y", "nx", "ny")


@query(f"SELECT DISTINCT x, y, nx, ny FROM {_near(_OFF(4, 'abs(a.i) + abs(b.i) <= 4'), True)}")
def grid_neighbors_r_vn_torus(spark, sf_dir):
    return g.neighbour_positions_within(grid(spark, sf_dir), grid_spec(spark, sf_dir, True), g.VON_NEUMANN, 4).select("x", "y", "nx", "ny")


@query(f"SELECT n.x, n.y, count(*) AS n, round(avg(c.v), 6) AS mean_v, max(c.v) AS max_v FROM {_near(_OFF(2))} n JOIN {GRID} c ON c.x = n.nx AND c.y = n.ny GROUP BY ALL")
def grid_focal_stats(spark, sf_dir):
    cells = grid(spark, sf_dir)
    near = g.neighbour_positions_within(g.dealt(cells.select("x", "y")), grid_spec(spark, sf_dir), g.MOORE, 2)
    return g.neighbour_values(near, cells, "v").groupBy("x", "y").agg(F.count("*").alias("n"), F.round(F.avg("n_v"), 6).alias("mean_v"), F.max("n_v").alias("max_v"))


_CELL = f"(SELECT x, y, y * {WIDTH} + x AS id FROM {GRID})"


def _pick_sql(offsets: str) -> str:
    drawn = child_sql(_CELL, 5, "0", "id")
    return f"""WITH n AS (SELECT c.x, c.y, c.h, c.x + dx AS nx, c.y + dy AS ny, row_number() OVER (PARTITION BY c.x, c.y ORDER BY dy, dx) - 1 AS k, count(*) OVER (PARTITION BY c.x, c.y) AS m
    FROM {drawn} c, {offsets} WHERE c.x + dx >= 0 AND c.y + dy >= 0 AND c.x + dx < {WIDTH} AND c.y + dy < {HEIGHT}) SELECT x, y, nx, ny FROM n WHERE k = floor({u01('h')} * m)::BIGINT"""


def _picked(spark, sf_dir, radius):
    cells = grid(spark, sf_dir).select("x", "y")
    word = rng.child_seed(5, F.lit(0).cast("long"), (F.col("y") * WIDTH + F.col("x")).cast("long"))
    return g.random_neighbour(cells, grid_spec(spark, sf_dir), word, g.MOORE, radius).select("x", "y", "nx", "ny")


@query(_pick_sql(_OFF(1)))
def grid_random_neighbor(spark, sf_dir):
    return _picked(spark, sf_dir, 1)


@query(_pick_sql(_OFF(3)))
def grid_random_neighbor_r(spark, sf_dir):
    return _picked(spark, sf_dir, 3)


def _diffuse_sql(offsets: str, parts: int, torus: bool = False) -> str:
    moves = _near(offsets, torus)
    return f"SELECT x, y, round(sum(d), 6) AS v FROM (SELECT x, y, v AS d FROM {GRID} UNION ALL SELECT x, y, -v * 0.5e0 / {parts} FROM {moves} UNION ALL SELECT nx, ny, v * 0.5e0 / {parts} FROM {moves}) GROUP BY x, y"


def _diffused(spark, sf_dir, kind, torus=False):
    return g.diffuse(grid(spark, sf_dir), grid_spec(spark, sf_dir, torus), "v", 0.5, kind).select("x", "y", F.round("v", 6).alias("v"))


@query(_diffuse_sql(_OFF(1), 8))
def grid_diffuse_moore(spark, sf_dir):
    return _diffused(spark, sf_dir, g.MOORE)


@query(_diffuse_sql(_OFF(1, _VN), 4))
def grid_diffuse_vn(spark, sf_dir):
    return _diffused(spark, sf_dir, g.VON_NEUMANN)


@query(_diffuse_sql(_OFF(1), 8, True))
def grid_diffuse_torus(spark, sf_dir):
    return _diffused(spark, sf_dir, g.MOORE, True)


@query(f"SELECT round(sum(v), 4) AS total FROM {GRID}")
def grid_total(spark, sf_dir):
    return grid(spark, sf_dir).agg(F.round(F.sum("v"), 4).alias("total"))


@query(f"SELECT x, y, round(v * 0.95e0, 6) AS v FROM {GRID}")
def grid_evaporate(spark, sf_dir):
    return grid(spark, sf_dir).select("x", "y", F.round(F.col("v") * 0.95, 6).alias("v"))


@query(f"SELECT x, y, least(CAST(floor(v) AS BIGINT) % 7 + 1, cap)::BIGINT AS sugar FROM {GRID}")
def grid_growback(spark, sf_dir):
    return grid(spark, sf_dir).select("x", "y", F.least(F.floor("v") % 7 + 1, F.col("cap").cast("long")).alias("sugar"))


_ANT = f"(SELECT idx, CAST(idx % {WIDTH} AS INT) AS x, CAST((idx * 7) % {HEIGHT} AS INT) AS y, CAST(1 + idx % 6 AS INT) AS vision FROM {AGENTS})"


@query(
    f"""WITH a AS {_ANT}, seen AS (SELECT a.idx, axis, dist, x + dx * dist AS nx, y + dy * dist AS ny FROM a, (VALUES (1, 0, 0), (-1, 0, 1), (0, 1, 2), (0, -1, 3)) AS o(dx, dy, axis), range(1, 7) AS r(dist) WHERE dist <= vision),
    free AS (SELECT s.*, c.cap FROM seen s JOIN {GRID} c ON c.x = s.nx AND c.y = s.ny WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.x = s.nx AND a.y = s.ny))
    SELECT idx, CAST(nx AS INT) AS nx, CAST(ny AS INT) AS ny, cap FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY cap DESC, dist, axis) AS k FROM free) WHERE k = 1"""
)
def grid_axis_vision(spark, sf_dir):
    """The free cell that each agent sees along the axes with the most sugar, the nearest of equals, the first axis of those."""
    spec, cells = grid_spec(spark, sf_dir), grid(spark, sf_dir)
    ants = agents(spark, sf_dir).select("idx", (F.col("idx") % WIDTH).cast("int").alias("x"), ((F.col("idx") * 7) % spec.height).cast("int").alias("y"), (1 + F.col("idx") % 6).cast("int").alias("vision"))
    seen = g.rays(ants, spec, F.col("vision"))
    taken = ants.select(F.col("x").alias("nx"), F.col("y").alias("ny")).distinct()
    free = g.neighbour_values(seen, cells, "cap").join(taken.hint("merge"), ["nx", "ny"], "left_anti")
    return free.groupBy("idx").agg(F.max_by(F.struct("nx", "ny", "n_cap"), F.struct("n_cap", -F.col("dist"), -F.col("axis"))).alias("b")).select("idx", F.col("b.nx").cast("int").alias("nx"), F.col("b.ny").cast("int").alias("ny"), F.col("b.n_cap").alias("cap"))


def _window_sql(score: str) -> str:
    return f"""WITH n AS (SELECT c.x, c.y, CAST(c.x + dx AS INT) AS bx, CAST(c.y + dy AS INT) AS "by", dx, dy, d.v - c.v AS drop_, c.v AS own, d.v AS v FROM {GRID} c, {_OFF(2)} o JOIN {GRID} d ON d.x = c.x + o.dx AND d.y = c.y + o.dy),
    r AS (SELECT *, {score} AS best, row_number() OVER (PARTITION BY x, y ORDER BY {score} DESC, dx, dy) AS k FROM n) SELECT x, y, bx, "by", round(best, 6) AS best FROM r WHERE k = 1"""


def _window_best(spark, sf_dir, score):
    cells = grid(spark, sf_dir)
    found = g.best_in_window(cells.select("x", "y", F.col("v").alias("own")), cells, grid_spec(spark, sf_dir), 2, score, ["x", "y"])
    return found.select("x", "y", F.col("bx").cast("int").alias("bx"), F.col("by").cast("int").alias("by"), F.round("best", 6).alias("best"))


@query(_window_sql("(own - v) / sqrt(CAST(dx * dx + dy * dy AS DOUBLE))"))
def grid_steepest_descent(spark, sf_dir):
    far = F.sqrt(F.pow(F.col("nx") - F.col("x"), F.lit(2)) + F.pow(F.col("ny") - F.col("y"), F.lit(2)))
    return _window_best(spark, sf_dir, (F.col("own") - F.col("n_v")) / far)


@query(
    f"""WITH n AS (SELECT c.x, c.y, d.x AS nx, d.y AS ny, dx, dy, c.cap / 100e0 AS velocity, c.v, d.v AS nv, (c.v - d.v) / (sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) * 30e0) AS slope FROM {GRID} c, {_OFF(2)} o JOIN {GRID} d ON d.x = c.x + o.dx AND d.y = c.y + o.dy),
    down AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY nv, dx, dy) AS k FROM n WHERE nv < v), flat AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY abs(nv - v), dx, dy) AS k FROM n WHERE velocity > 0.3e0 AND slope >= -0.05e0)
    SELECT x, y, nx AS bx, ny AS "by", round(slope, 9) AS slope, FALSE AS flat FROM down WHERE k = 1 UNION ALL SELECT x, y, nx, ny, round(slope, 9), TRUE FROM flat WHERE k = 1 AND (x, y) NOT IN (SELECT (x, y) FROM down)"""
)
def grid_min_elevation(spark, sf_dir):
    """The lowest cell below each cell's own height within 2 and the slope to it; where none is below, and the flow there is faster than 0.3, the flattest way on."""
    cells = grid(spark, sf_dir)
    out = g.lowest_or_flat(cells, cells.select("x", "y", "v"), grid_spec(spark, sf_dir), 2, 30.0, moving=F.col("cap") / 100.0 > 0.3)
    return out.select("x", "y", "bx", "by", F.round("slope", 9).alias("slope"), "flat")


@query(f"SELECT DISTINCT CAST(c.x + dx AS INT) AS x, CAST(c.y + dy AS INT) AS y FROM (SELECT * FROM {GRID} WHERE cap = 50) c, (SELECT a.i AS dx, b.i AS dy FROM range(-3, 4) a(i), range(-3, 4) b(i) WHERE a.i * a.i + b.i * b.i < 9) WHERE c.x + dx >= 0 AND c.y + dy >= 0 AND c.x + dx < {WIDTH} AND c.y + dy < {HEIGHT}")
def grid_disc_footprint(spark, sf_dir):
    return g.disc(grid(spark, sf_dir).where("cap = 50"), grid_spec(spark, sf_dir), 3)


@query(f"SELECT p.idx, c.v FROM (SELECT idx, least(greatest(CAST(floor(px / 1000 * {WIDTH}) AS INT), 0), {WIDTH} - 1) AS x, least(greatest(CAST(floor((1 - py / 1000) * {HEIGHT}) AS INT), 0), {HEIGHT} - 1) AS y FROM {POINTS}) p JOIN {GRID} c USING (x, y)")
def raster_point_sample(spark, sf_dir):
    return g.sample_points(points(spark, sf_dir), grid(spark, sf_dir), grid_spec(spark, sf_dir), 1000.0, "v").select("idx", "v")


_COMPASS = [(1.0, 0.0), (0.7071, 0.7071), (0.0, 1.0), (-0.7071, 0.7071), (-1.0, 0.0), (-0.7071, -0.7071), (0.0, -1.0), (0.7071, -0.7071)]
_COMPASS_SQL = ", ".join(f"({k}, {x!r}e0, {y!r}e0)" for k, (x, y) in enumerate(_COMPASS))
_AT = lambda px, py: f"least(greatest(CAST(floor(({px}) / 1000 * {WIDTH}) AS INT), 0), {WIDTH} - 1) AS x, least(greatest(CAST(floor((1 - ({py}) / 1000) * {HEIGHT}) AS INT), 0), {HEIGHT} - 1) AS y"


@query(
    f"""WITH p AS {POINTS}, own AS (SELECT idx, c.v AS own FROM (SELECT idx, {_AT('px', 'py')} FROM p) JOIN {GRID} c USING (x, y)),
    probe AS (SELECT idx, k, c.v FROM (SELECT idx, k, {_AT('px + 50 * ox', 'py + 50 * oy')} FROM p, (VALUES {_COMPASS_SQL}) o(k, ox, oy)) JOIN {GRID} c USING (x, y)),
    b AS (SELECT idx, k, v, row_number() OVER (PARTITION BY idx ORDER BY v DESC, k) AS r FROM probe)
    SELECT b.idx, CASE WHEN v > own THEN k ELSE -1 END AS direction FROM b JOIN own USING (idx) WHERE r = 1"""
)
def raster_best_direction(spark, sf_dir):
    """The first of eight directions, 50 away, whose cell has the greatest value, -1 if none has more than the own cell."""
    return g.best_direction(points(spark, sf_dir), grid(spark, sf_dir), grid_spec(spark, sf_dir), 1000.0, "v", _COMPASS, 50.0)


@query(f"SELECT x, y, round(greatest(least(0.5e0 + 0.3e0 * sin(x * 0.7e0) * cos(y * 0.3e0) + 0.2e0 * sin(y * 1.1e0), 1e0), 0e0), 9) AS v FROM {GRID}")
def raster_synthetic(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    wave = 0.5 + 0.3 * F.sin(x * 0.7) * F.cos(y * 0.3) + 0.2 * F.sin(y * 1.1)
    return g.from_fn(spark, grid_spec(spark, sf_dir), v=F.round(F.greatest(F.least(wave, F.lit(1.0)), F.lit(0.0)), 9))


_PEAK = lambda cx, cy: f"sqrt(pow(x - {cx} * {WIDTH}, 2) + pow(y - {cy} * {HEIGHT}, 2)) / (0.55e0 * least({WIDTH}, {HEIGHT}))"
_BAND = lambda d: f"CASE WHEN {d} < 0.18e0 THEN 4 WHEN {d} < 0.37e0 THEN 3 WHEN {d} < 0.62e0 THEN 2 WHEN {d} < 1 THEN 1 ELSE 0 END"


@query(f"SELECT x, y, greatest({_BAND(_PEAK('0.75e0', '0.25e0'))}, {_BAND(_PEAK('0.25e0', '0.75e0'))}) AS capacity FROM {GRID}")
def grid_capacity_bands(spark, sf_dir):
    """Two sugar peaks with capacity 4 falling to 0 in bands of relative distance."""
    spec = grid_spec(spark, sf_dir)
    return g.from_fn(spark, spec, capacity=F.greatest(capacity_band(spec, 0.75, 0.25), capacity_band(spec, 0.25, 0.75)))


@query(f"SELECT c.x, c.y, CASE WHEN a.idx IS NULL THEN 0 WHEN a.grp = 'BUILDING' THEN 1 ELSE 2 END AS category FROM {GRID} c LEFT JOIN (SELECT idx, grp, CAST(idx % {WIDTH} AS INT) AS x, CAST(idx // {WIDTH} AS INT) AS y FROM {AGENTS}) a USING (x, y)")
def grid_category_map(spark, sf_dir):
    placed = agents(spark, sf_dir).select("idx", "grp", (F.col("idx") % WIDTH).cast("int").alias("x"), F.expr(f"cast(idx div {WIDTH} as int)").alias("y"))
    return grid(spark, sf_dir).select("x", "y").join(placed, ["x", "y"], "left").select("x", "y", F.when(F.col("idx").isNull(), 0).when(F.col("grp") == "BUILDING", 1).otherwise(2).alias("category"))
