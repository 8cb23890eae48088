"""Stencils of long reach over the part grid in tiles; each with its SQL over offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentframe.operators import tiles as t
from agentframe.plans.declare import query
from agentframe.plans.fixtures import GRID, HEIGHT, WIDTH, grid, grid_spec
from agentframe.plans.grid_plans import _CLIP, _OFF

#: Sides of tiles here: small, as the grid is only so wide; t.Tiling has 256 unless stated.
SIDE = 16


def _tiles(spark, sf_dir, *values, torus=False, cells=None):
    tiling = t.Tiling(grid_spec(spark, sf_dir, torus), SIDE)
    return t.cut(grid(spark, sf_dir) if cells is None else cells, tiling, *values), tiling


def _window(r: int, values: str, keep: str = "TRUE") -> str:
    return f"(SELECT c.x, c.y, c.v, c.cap, dx, dy, {values} FROM {GRID} c, (SELECT dx, dy FROM {_OFF(r)} UNION ALL SELECT 0, 0) o JOIN {GRID} n ON n.x = c.x + dx AND n.y = c.y + dy WHERE {keep})"


@query(f"SELECT x, y, count(*) AS n, CAST(sum(n_cap) AS BIGINT) AS total, min(n_cap) AS least, max(n_cap) AS most FROM {_window(10, 'n.cap AS n_cap')} GROUP BY x, y")
def tile_window_stats(spark, sf_dir):
    """Counts, sums and extremes of each cell's 21 x 21 window."""
    tiles, tiling = _tiles(spark, sf_dir, "cap")
    out = t.cells_of(t.window_stats(tiles, tiling, 10, "cap"), tiling)
    return out.select("x", "y", F.col("n").cast("long").alias("n"), F.col("sum").cast("long").alias("total"), F.col("least").cast("int").alias("least"), F.col("most").cast("int").alias("most"))


@query(
    f"""WITH g AS {GRID}, o AS (SELECT CAST(i AS INT) AS dx, CAST(j AS INT) AS dy FROM (SELECT unnest(range(-12, 8)) AS i), (SELECT unnest(range(-least(12, h - 1), least(12, h - 1 - least(12, h - 1)) + 1)) AS j FROM (SELECT {HEIGHT} AS h)))
    SELECT c.x, c.y, count(*) AS n, round(avg(n.v), 4) AS mean, max(n.v) AS most FROM g c, o JOIN g n ON n.x = (c.x + dx + {WIDTH}) % {WIDTH} AND n.y = (c.y + dy + {HEIGHT}) % {HEIGHT} GROUP BY ALL"""
)
def tile_focal_mean_torus(spark, sf_dir):
    """Focal means and maxima at radius 12 on a torus that is narrower than the window: no column counts twice, and no row where it is lower too."""
    tiles, tiling = _tiles(spark, sf_dir, "v", torus=True)
    return t.cells_of(t.window_stats(tiles, tiling, 12, "v"), tiling).select("x", "y", F.col("n").cast("long").alias("n"), F.round("mean", 4).alias("mean"), "most")


@query(f"SELECT x, y, nx AS bx, ny AS \"by\", score AS best FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY score DESC, dx, dy) AS k FROM {_window(11, 'n.x AS nx, n.y AS ny, n.v AS score', 'dx <> 0 OR dy <> 0')}) WHERE k = 1")
def tile_window_best(spark, sf_dir):
    """The best other cell of each 23 x 23 window."""
    tiles, tiling = _tiles(spark, sf_dir, "v")
    return t.cells_of(t.best_in_window(tiles, tiling, 11, "v"), tiling).select("x", "y", F.col("bx").cast("int").alias("bx"), F.col("by").cast("int").alias("by"), "best")


_SLOPE = "(v - n_v) / (sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) * 30e0)"


@query(
    f"""WITH w AS {_window(10, 'n.x AS nx, n.y AS ny, n.v AS n_v', '(dx <> 0 OR dy <> 0) AND c.y % 3 = 0')}, down AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n_v, dx, dy) AS k FROM w WHERE n_v < v), flat AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY abs(n_v - v), dx, dy) AS k FROM w WHERE {_SLOPE} >= -0.05e0)
    SELECT x, y, nx AS bx, ny AS "by", FALSE AS flat FROM down WHERE k = 1 UNION ALL SELECT x, y, nx, ny, TRUE FROM flat WHERE k = 1 AND (x, y) NOT IN (SELECT (x, y) FROM down)"""
)
def tile_lowest_or_flat(spark, sf_dir):
    """The way down from each third row's cells within 10, or the flattest way where there is none."""
    tiles, tiling = _tiles(spark, sf_dir, "v")
    out = t.cells_of(t.lowest_or_flat(tiles, tiling, 10, "v", 30.0), tiling).where("y % 3 = 0")
    return out.select("x", "y", F.col("bx").cast("int").alias("bx"), F.col("by").cast("int").alias("by"), (F.col("flat") == 1).alias("flat"))


_NEAR = f"(SELECT c.x, c.y, count(*) AS k FROM {GRID} c, {_OFF(1)} WHERE {_CLIP.replace('nx', '(x + dx)').replace('ny', '(y + dy)')} GROUP BY ALL)"
_STEP = lambda src: f"(SELECT c.x, c.y, c.v - c.v * 0.047125e0 * k + coalesce(sum(n.v * 0.047125e0), 0) AS v FROM {src} c JOIN near USING (x, y) JOIN o ON TRUE LEFT JOIN {src} n ON n.x = c.x + dx AND n.y = c.y + dy GROUP BY c.x, c.y, c.v, k)"


@query(f"WITH near AS {_NEAR}, o AS {_OFF(1)}, g AS {GRID}, a AS {_STEP('g')}, b AS {_STEP('a')}, d AS {_STEP('b')} SELECT x, y, round(v, 4) AS v FROM d")
def tile_diffuse(spark, sf_dir):
    """Three steps of diffusion for one exchange."""
    tiles, tiling = _tiles(spark, sf_dir, "v")
    return t.cells_of(t.diffuse(tiles, tiling, "v", 0.377, 3), tiling).select("x", "y", F.round("v", 4).alias("v"))


@query(f"SELECT DISTINCT x + dx AS x, y + dy AS y FROM {GRID} c, (SELECT dx, dy FROM {_OFF(9)} UNION ALL SELECT 0, 0) WHERE cap = 17 AND dx * dx + dy * dy < 81 AND {_CLIP.replace('nx', '(x + dx)').replace('ny', '(y + dy)')}")
def tile_disc(spark, sf_dir):
    """All cells less than 9 away from a marked one."""
    tiles, tiling = _tiles(spark, sf_dir, "cap", cells=grid(spark, sf_dir).where("cap = 17"))
    return t.cells_of(t.disc(tiles, tiling, 9, "cap"), tiling).select("x", "y")
