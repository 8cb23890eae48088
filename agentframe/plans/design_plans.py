"""Experiment-design queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from agentframe.operators import batch, streams
from agentframe.operators import design as d
from agentframe.plans.declare import query
from agentframe.plans.fixtures import table
from agentframe.plans.random_plans import child_sql, mix_sql, u01

N, SEED = 256, 9
_U = lambda dim: f"u{dim}"


def _uniforms_sql(dims: int) -> str:
    """(row, u0..) of independent draws."""
    source = f"(SELECT range AS \"row\" FROM range({N}))"
    for k in range(dims):
        source = f"(SELECT * EXCLUDE (h), {u01('h')} AS u{k} FROM {child_sql(source, SEED, str(k), chr(34) + 'row' + chr(34))})"
    return source


def _uniforms(spark, dims):
    return spark.range(N).select(F.col("id").alias("row"), *[d.draw(SEED, k, F.col("id")).alias(f"u{k}") for k in range(dims)])


@query(f"SELECT \"row\", round(-1e0 + u0 * 3e0, 6) AS x, round(10e0 + u1 * 5e0, 6) AS y FROM {_uniforms_sql(2)}")
def design_scale(spark, sf_dir):
    return _uniforms(spark, 2).select("row", F.round(d.scaled(F.col("u0"), -1.0, 2.0), 6).alias("x"), F.round(d.scaled(F.col("u1"), 10.0, 15.0), 6).alias("y"))


_LHS = mix_sql(f"(SELECT \"row\", dim, h >> 1 AS h FROM {child_sql(f'(SELECT a.range AS {chr(34)}row{chr(34)}, b.range AS dim FROM range({N}) a, range(3) b)', SEED, 'dim', chr(34) + 'row' + chr(34))})", "h", "j")


@query(f"SELECT \"row\", CAST(dim AS INT) AS dim, round(dim + (row_number() OVER (PARTITION BY dim ORDER BY h, \"row\") - 1 + {u01('j')}) / {N} * 2, 6) AS value FROM {_LHS}")
def design_lhs(spark, sf_dir):
    """Latin hypercube of three parameters on [dim, dim + 2)."""
    return d.latin_hypercube(spark, [(0.0, 2.0), (1.0, 3.0), (2.0, 4.0)], N, SEED).select("row", "dim", F.round("value", 6).alias("value"))


_DIRS = ", ".join(f"({k}, {j}, {v})" for k in range(4) for j, v in enumerate(d.direction_numbers(k)))
_POINT = f"(SELECT p.range AS \"row\", dim, bit_xor(v)::DOUBLE / {1 << d.BITS} AS u FROM range({N}) p, (VALUES {_DIRS}) t(dim, j, v) WHERE (xor(p.range + {N}, (p.range + {N}) >> 1) >> j) & 1 = 1 GROUP BY ALL)"
_WIDE = ", ".join(f"max(u) FILTER (WHERE dim = {k}) AS {'ab'[k // 2]}{k % 2}" for k in range(4))


@query(f"SELECT \"row\", {_WIDE} FROM {_POINT} GROUP BY \"row\"")
def design_sobol(spark, sf_dir):
    return d.sobol_design(spark, 2, N)


@query(f"WITH w AS (SELECT \"row\", {_WIDE} FROM {_POINT} GROUP BY \"row\") SELECT \"row\", 'A' AS block, a0 AS x0, a1 AS x1 FROM w UNION ALL SELECT \"row\", 'B', b0, b1 FROM w UNION ALL SELECT \"row\", 'AB0', b0, a1 FROM w UNION ALL SELECT \"row\", 'AB1', a0, b1 FROM w")
def design_saltelli(spark, sf_dir):
    return d.saltelli(d.sobol_design(spark, 2, N), 2)


_ISHI = lambda a, b, c: f"sin({a}) + 7 * pow(sin({b}), 2) + 0.1e0 * pow({c}, 4) * sin({a})"
_X = lambda k: f"(-pi() + u{k} * 2 * pi())"


def _runs_sql() -> str:
    blocks = [("A", (0, 1, 2)), ("B", (3, 4, 5)), ("AB0", (3, 1, 2)), ("AB1", (0, 4, 2)), ("AB2", (0, 1, 5))]
    return "(" + " UNION ALL ".join(f"SELECT \"row\", '{n}' AS block, {_ISHI(*map(_X, c))} AS y FROM {_uniforms_sql(6)}" for n, c in blocks) + ")"


def _runs(spark):
    """The Ishigami function (7, 0.1) on the Saltelli blocks of independent draws."""
    base = _uniforms(spark, 6)
    named = base.select("row", *[(-math.pi + F.col(f"u{k}") * 2 * math.pi).alias(f"{'ab'[k // 3]}{k % 3}") for k in range(6)])
    y = F.sin("x0") + 7 * F.pow(F.sin("x1"), F.lit(2)) + 0.1 * F.pow("x2", F.lit(4)) * F.sin("x0")
    return d.saltelli(named, 3).select("row", "block", y.alias("y"))


def _indices_sql(source: str, by: str = "") -> str:
    pre = f"{by}, " if by else ""
    on = f"USING ({pre}\"row\")"
    pairs = f"(SELECT {pre}\"row\", ya, yb, param, yab FROM (SELECT {pre}\"row\", y AS ya FROM {source} WHERE block = 'A') JOIN (SELECT {pre}\"row\", y AS yb FROM {source} WHERE block = 'B') {on} JOIN (SELECT {pre}\"row\", CAST(right(block, 1) AS INT) AS param, y AS yab FROM {source} WHERE block LIKE 'AB%') {on})"
    return f"(SELECT {pre}param, avg(yb * (yab - ya)) / var AS s1, avg(pow(ya - yab, 2)) / 2 / var AS st FROM (SELECT *, (sum(ya * ya) OVER w + sum(yb * yb) OVER w) / (2 * count(*) OVER w) - pow((sum(ya) OVER w + sum(yb) OVER w) / (2 * count(*) OVER w), 2) AS var FROM {pairs} WINDOW w AS (PARTITION BY {pre}param)) GROUP BY ALL)".replace("GROUP BY ALL", f"GROUP BY {pre}param, var")


@query(f"WITH y AS {_runs_sql()} SELECT param, round(s1, 5) AS s1, round(st, 5) AS st FROM {_indices_sql('y')}")
def sobol_indices(spark, sf_dir):
    return d.sobol_indices(_runs(spark), 3).select("param", F.round("s1", 5).alias("s1"), F.round("st", 5).alias("st"))


_PICK = child_sql(f"(SELECT b.range AS boot, k.range AS k FROM range(40) b, range({N}) k)", 77, "boot", "k")


@query(
    f"""WITH y AS {_runs_sql()}, p AS (SELECT boot, k, floor({u01('h')} * {N})::BIGINT AS pick FROM {_PICK}), s AS (SELECT boot, k AS "row", block, y.y FROM p JOIN y ON y."row" = p.pick),
    e AS (SELECT *, row_number() OVER (PARTITION BY param ORDER BY s1) AS r1, row_number() OVER (PARTITION BY param ORDER BY st) AS rt FROM {_indices_sql('s', 'boot')})
    SELECT param, round(max(s1) FILTER (WHERE r1 = 2), 5) AS s1_low, round(max(s1) FILTER (WHERE r1 = 39), 5) AS s1_high, round(max(st) FILTER (WHERE rt = 2), 5) AS st_low, round(max(st) FILTER (WHERE rt = 39), 5) AS st_high FROM e GROUP BY param"""
)
def sobol_bootstrap(spark, sf_dir):
    return d.bootstrap(_runs(spark), 3, N, 40, 77).select("param", *[F.round(c, 5).alias(c) for c in ("s1_low", "s1_high", "st_low", "st_high")])


def _morris_sql() -> str:
    source = "(SELECT range AS traj FROM range(64))"
    for k in range(3):
        source = f"(SELECT * EXCLUDE (h), floor({u01('h')} * 2)::BIGINT / 3e0 AS s{k} FROM {child_sql(source, 4, str(k), 'traj')})"
        source = f"(SELECT * EXCLUDE (h), h >> 1 AS o{k} FROM {child_sql(source, 4, str(100 + k), 'traj')})"
    places = ", ".join(f"(SELECT count(*) FROM (VALUES (o0, 0), (o1, 1), (o2, 2)) t(o, i) WHERE o < o{k} OR (o = o{k} AND i <= {k})) AS p{k}" for k in range(3))
    return f"(SELECT *, {places} FROM {source})"


_TRAJ = f"(SELECT traj, CAST(k.range AS INT) AS k, CASE WHEN k.range = 0 THEN -1 WHEN p0 = k.range THEN 0 WHEN p1 = k.range THEN 1 ELSE 2 END AS dim, " + ", ".join(f"s{i} + CASE WHEN p{i} <= k.range THEN 4 / 6e0 ELSE 0 END AS x{i}" for i in range(3)) + f" FROM {_morris_sql()}, range(4) k)"


@query(f"SELECT traj, k, dim, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM {_TRAJ}")
def design_morris(spark, sf_dir):
    return d.morris(spark, 3, 64, 4, 4).select("traj", "k", "dim", *[F.round(f"x{i}", 6).alias(f"x{i}") for i in range(3)])


@query(f"WITH y AS (SELECT *, x0 * 2 + x1 * x1 + x0 * x2 AS y FROM {_TRAJ}), e AS (SELECT dim, k, (y - lag(y) OVER (PARTITION BY traj ORDER BY k)) / (4 / 6e0) AS ee FROM y) SELECT dim, round(avg(ee), 5) AS mu, round(avg(abs(ee)), 5) AS mu_star, round(stddev_samp(ee), 5) AS sigma FROM e WHERE k > 0 GROUP BY dim")
def morris_effects(spark, sf_dir):
    runs = d.morris(spark, 3, 64, 4, 4).withColumn("y", F.col("x0") * 2 + F.col("x1") * F.col("x1") + F.col("x0") * F.col("x2"))
    return d.morris_effects(runs, 4 / 6.0).select("dim", *[F.round(c, 5).alias(c) for c in ("mu", "mu_star", "sigma")])


@query("SELECT r_regionkey AS config, n_nationkey AS seed FROM region, nation")
def sweep_grid_cartesian(spark, sf_dir):
    configs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("config"))
    return batch.tasks(configs, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seed")))


def _seeds(spark, n):
    return spark.range(n).withColumnRenamed("id", "seed")


@query()
def rng_chacha_golden(spark, sf_dir):
    """The first exact draws of a few seeds."""
    return streams.first_draws(_seeds(spark, 8), 4)


@query()
def design_optimise(spark, sf_dir):
    """The best point of a smooth function by each method, a generation a job."""
    value = lambda x: x.select("id", (-(F.pow(F.get("x", 0) - 0.3, F.lit(2)) + F.pow(F.get("x", 1) + 0.2, F.lit(2)))).alias("value"))
    rows = [(m, *batch.maximise(spark, value, [(-1.0, 1.0)] * 2, 4, 12, 5, m)) for m in ("de", "ga", "pso", "gwo", "sa")]
    return spark.createDataFrame([(m, float(y)) for m, _, y in rows], "method string, best double")
