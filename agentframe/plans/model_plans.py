"""Whole models: synchronous ones as chained steps with SQL beside them, serial ones as one task a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.operators import epidemics, models, nearest, populations, rules
from agentframe.operators import space as s
from agentframe.operators.graph import both_ways
from agentframe.operators.grid import GridSpec
from agentframe.plans.declare import query
from agentframe.plans.fixtures import CUSTOMERS, GRID, HEIGHT, NET, POINTS, SPACE, TORUS, WIDTH, customers, grid, grid_spec, net, panel, points, table
from agentframe.plans.random_plans import child_sql, u01

_OFF = "(SELECT CAST(a.i AS INT) AS dx, CAST(b.i AS INT) AS dy FROM range(-1, 2) AS a(i), range(-1, 2) AS b(i) WHERE a.i <> 0 OR b.i <> 0)"
_IN = f"nx >= 0 AND ny >= 0 AND nx < {WIDTH} AND ny < {HEIGHT}"
_MOD = lambda e, n: f"((({e}) % {n} + {n}) % {n})"


def _life_sql(steps: int) -> str:
    parts = [f"s0 AS (SELECT x, y, cap % 3 = 0 AS alive FROM {GRID})"]
    for k in range(steps):
        near = f"(SELECT nx AS x, ny AS y, count(*) AS n FROM (SELECT x + dx AS nx, y + dy AS ny FROM s{k}, {_OFF} WHERE alive) GROUP BY ALL)"
        parts.append(f"s{k + 1} AS (SELECT c.x, c.y, coalesce(n, 0) = 3 OR (alive AND coalesce(n, 0) = 2) AS alive FROM s{k} c LEFT JOIN {near} USING (x, y))")
    return "WITH " + ", ".join(parts) + f" SELECT x, y, alive FROM s{steps}"


def _life(spark, sf_dir, steps):
    spec = grid_spec(spark, sf_dir)
    start = grid(spark, sf_dir).select("x", "y", (F.col("cap") % 3 == 0).alias("alive"))
    return models.run(start, lambda c, _: models.life_step(c, spec), steps)


@query(_life_sql(1))
def sched_simultaneous_life(spark, sf_dir):
    return _life(spark, sf_dir, 1)


@query(_life_sql(4))
def model_life(spark, sf_dir):
    return _life(spark, sf_dir, 4)


_RULE = lambda key: f"CASE WHEN status = 'S' AND coalesce(k, 0) > 0 AND {u01('h')} < 1 - pow(0.8e0, coalesce(k, 0)) THEN 'I' WHEN status = 'I' AND {u01('h')} < 0.1e0 THEN 'R' ELSE status END AS status"


def _sir_sql(steps: int) -> str:
    parts = [f"s0 AS (SELECT x, y, CASE WHEN cap > 47 THEN 'I' ELSE 'S' END AS status FROM {GRID})"]
    for k in range(steps):
        near = f"(SELECT nx AS x, ny AS y, count(*) AS k FROM (SELECT {_MOD('x + dx', WIDTH)} AS nx, {_MOD('y + dy', HEIGHT)} AS ny FROM s{k}, {_OFF} WHERE status = 'I') GROUP BY ALL)"
        drawn = child_sql(f"(SELECT *, y * {WIDTH} + x AS cell FROM s{k})", 21, str(k), "cell")
        parts.append(f"s{k + 1} AS (SELECT c.x, c.y, {_RULE('cell')} FROM {drawn} c LEFT JOIN {near} USING (x, y))")
    return "WITH " + ", ".join(parts) + f" SELECT x, y, status FROM s{steps}"


@query(_sir_sql(3))
def model_sir_sync(spark, sf_dir):
    """Three synchronous SIR steps on the torus."""
    spec = grid_spec(spark, sf_dir, True)
    start = grid(spark, sf_dir).select("x", "y", F.when(F.col("cap") > 47, "I").otherwise("S").alias("status"))
    return models.run(start, lambda c, k: models.sir_step(c, spec, k, 21, 0.2, 0.1), 3)


def _network_sql(steps: int) -> str:
    parts = [f"e AS (SELECT src, dst FROM {NET} UNION ALL SELECT dst, src FROM {NET})", "s0 AS (SELECT DISTINCT src AS id, CASE WHEN src % 40 = 0 THEN 'I' ELSE 'S' END AS status FROM e)"]
    for k in range(steps):
        drawn = child_sql(f"s{k}", 22, str(k), "id")
        parts.append(f"s{k + 1} AS (SELECT c.id, {_RULE('id')} FROM {drawn} c LEFT JOIN (SELECT src AS id, count(*) AS k FROM e JOIN s{k} ON s{k}.id = dst WHERE status = 'I' GROUP BY src) USING (id))")
    return "WITH " + ", ".join(parts) + f" SELECT id, status FROM s{steps}"


def _network(spark, sf_dir):
    """(edges both ways, nodes with status) of the trade network, settled because each step reads them."""
    edges = models.settled(both_ways(net(spark, sf_dir).select("src", "dst")))
    return edges, edges.select(F.col("src").alias("id")).distinct().withColumn("status", F.when(F.col("id") % 40 == 0, "I").otherwise("S"))


@query(_network_sql(2))
def model_network_sir_sync(spark, sf_dir):
    edges, start = _network(spark, sf_dir)
    return models.run(start, lambda c, k: models.network_sir_step(c, edges, k, 22, 0.2, 0.1), 2)


_START = f"(SELECT idx, CAST(idx % {WIDTH} AS INT) AS x, CAST((idx * 3) % {HEIGHT} AS INT) AS y FROM {CUSTOMERS})"


def _walk_sql(steps: int) -> list[str]:
    parts = [f"w0 AS {_START}"]
    for k in range(steps):
        drawn = child_sql(f"w{k}", 23, str(k), "idx")
        near = f"(SELECT idx, h, {_MOD('x + dx', WIDTH)} AS nx, {_MOD('y + dy', HEIGHT)} AS ny, row_number() OVER (PARTITION BY idx ORDER BY dy, dx) - 1 AS p FROM {drawn}, {_OFF})"
        parts.append(f"w{k + 1} AS (SELECT idx, CAST(nx AS INT) AS x, CAST(ny AS INT) AS y FROM {near} WHERE p = floor({u01('h')} * 8)::BIGINT)")
    return parts


def _walkers(spark, sf_dir):
    spec = grid_spec(spark, sf_dir, True)
    start = customers(spark, sf_dir).select("idx", (F.col("idx") % WIDTH).cast("int").alias("x"), ((F.col("idx") * 3) % spec.height).cast("int").alias("y"))
    return spec, start


@query("WITH " + ", ".join(_walk_sql(3)) + " SELECT idx, x, y FROM w3")
def model_walkers(spark, sf_dir):
    spec, start = _walkers(spark, sf_dir)
    return models.run(start, lambda w, k: models.walk_step(w, spec, k, 23), 3)


def _pheromone_sql() -> str:
    parts = [*_walk_sql(2), f"f0 AS (SELECT x, y, 0e0 AS v FROM {GRID})"]
    for k in range(2):
        parts.append(f"d{k} AS (SELECT c.x, c.y, v + coalesce(n, 0) AS v FROM f{k} c LEFT JOIN (SELECT x, y, count(*) AS n FROM w{k + 1} GROUP BY ALL) USING (x, y))")
        moves = f"(SELECT x, y, v, {_MOD('x + dx', WIDTH)} AS nx, {_MOD('y + dy', HEIGHT)} AS ny FROM d{k}, {_OFF})"
        parts.append(f"f{k + 1} AS (SELECT x, y, sum(v) * (1 - 0.0513e0) AS v FROM (SELECT x, y, v FROM d{k} UNION ALL SELECT x, y, -v * 0.4711e0 / 8 FROM {moves} UNION ALL SELECT nx, ny, v * 0.4711e0 / 8 FROM {moves}) GROUP BY x, y)")
    return "WITH " + ", ".join(parts) + " SELECT x, y, round(v, 4) + 0 AS v FROM f2"


@query(_pheromone_sql())
def model_diffusion(spark, sf_dir):
    """Walkers deposit, the field diffuses and fades: two steps."""
    spec, walkers = _walkers(spark, sf_dir)
    field = grid(spark, sf_dir).select("x", "y", F.lit(0.0).alias("v"))
    for k in range(2):
        walkers = models.walk_step(walkers, spec, k, 23)
        field = models.pheromone_step(field, walkers, spec, 0.4711, 0.0513)
    return field.select("x", "y", (F.round("v", 4) + 0).alias("v"))


_D = lambda c, t: f"CASE WHEN abs({t} - {c}) > 500 THEN ({t} - {c}) - 1000 * sign({t} - {c}) ELSE {t} - {c} END"


@query(
    f"""WITH p AS (SELECT a.idx, b.idx AS q, {_D('a.px', 'b.px')} AS tx, {_D('a.py', 'b.py')} AS ty FROM {CUSTOMERS} a, {POINTS} b), n AS (SELECT *, sqrt(tx * tx + ty * ty) AS d FROM p WHERE sqrt(tx * tx + ty * ty) <= 20),
    b AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d, q) AS k FROM n), m AS (SELECT c.idx, px + coalesce(CASE WHEN d > 3 THEN tx * 3 / d ELSE tx END, 0) AS px, py + coalesce(CASE WHEN d > 3 THEN ty * 3 / d ELSE ty END, 0) AS py FROM {CUSTOMERS} c LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (idx))
    SELECT idx, round(px - floor(px / 1000) * 1000, 5) AS px, round(py - floor(py / 1000) * 1000, 5) AS py FROM m"""
)
def model_prey_kernel(spark, sf_dir):
    """Predators step towards the nearest prey within reach."""
    out = models.chase_step(customers(spark, sf_dir), points(spark, sf_dir), TORUS, 20.0, 3.0)
    return out.select("idx", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"))


@query(
    f"""WITH p AS (SELECT a.idx, {_D('a.px', 'b.px')} AS tx, {_D('a.py', 'b.py')} AS ty, b.idx AS q FROM {CUSTOMERS} a, {POINTS} b), n AS (SELECT idx, q, tx, ty, sqrt(tx * tx + ty * ty) AS d FROM p WHERE sqrt(tx * tx + ty * ty) <= 20),
    b AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d, q) AS k FROM n),
    m AS (SELECT c.idx, px + coalesce(CASE WHEN d > 3 THEN tx * 3 / d ELSE tx END, 3 * cos({u01('h')} * 2 * pi())) AS px, py + coalesce(CASE WHEN d > 3 THEN ty * 3 / d ELSE ty END, 3 * sin({u01('h')} * 2 * pi())) AS py FROM {child_sql(CUSTOMERS, 24, '0', 'idx')} c LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (idx))
    SELECT idx, round(px - floor(px / 1000) * 1000, 4) AS px, round(py - floor(py / 1000) * 1000, 4) AS py FROM m"""
)
def model_prey_roaming(spark, sf_dir):
    """Predators step towards the nearest prey within reach, or at random without one."""
    angle = rng.uniform(rng.child_seed(24, 0, F.col("idx"))) * (2 * F.pi())
    out = models.chase_step(customers(spark, sf_dir), points(spark, sf_dir), TORUS, 20.0, 3.0, angle)
    return out.select("idx", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query()
def model_boids(spark, sf_dir):
    """Three flocking steps."""
    start = customers(spark, sf_dir).select("idx", "px", "py", (F.col("idx") % 7 - 3).cast("double").alias("vx"), (F.col("idx") % 5 - 2).cast("double").alias("vy"))
    return models.run(start, lambda b, _: s.flock(b, TORUS, 40.0, (1.5, 1.0, 0.8), 2.0), 3, cut=1)


_CELLS = f"(SELECT CAST(count(*) AS BIGINT) FROM {GRID})"


def _runs_sql(runs: str, steps: int, beta: str, by: str) -> str:
    """CTEs s0 .. s<steps> of synchronous SIR rasters, one for each row of runs (run and the columns by)."""
    parts = [f"r AS ({runs})", f"s0 AS (SELECT {by}, run, x, y, CASE WHEN cap > 47 THEN 'I' ELSE 'S' END AS status FROM {GRID}, r)"]
    for k in range(steps):
        near = f"(SELECT run, nx AS x, ny AS y, count(*) AS k FROM (SELECT run, {_MOD('x + dx', WIDTH)} AS nx, {_MOD('y + dy', HEIGHT)} AS ny FROM s{k}, {_OFF} WHERE status = 'I') GROUP BY ALL)"
        drawn = child_sql(f"(SELECT *, run * {_CELLS} + y * {WIDTH} + x AS cell FROM s{k})", 31, str(k), "cell")
        rule = _RULE("cell").replace("0.8e0", f"(1 - {beta})")
        parts.append(f"s{k + 1} AS (SELECT {by}, c.run, c.x, c.y, {rule} FROM {drawn} c LEFT JOIN {near} USING (run, x, y))")
    return "WITH " + ", ".join(parts)


_COUNTS = "count_if(status = 'S')::BIGINT AS s, count_if(status = 'I')::BIGINT AS i, count_if(status = 'R')::BIGINT AS r"


def _series_sql(runs: str, steps: int, beta: str, by: str) -> str:
    each = " UNION ALL ".join(f"SELECT {by}, {k}::BIGINT AS step, {_COUNTS} FROM s{k} GROUP BY {by}" for k in range(steps + 1))
    return f"{_runs_sql(runs, steps, beta, by)} {each}"


def _sir_series(spark, sf_dir, runs, by, beta, steps):
    """(by, step, s, i, r) of one synchronous SIR raster for each row of runs (run, by), all in the same steps."""
    spec = grid_spec(spark, sf_dir, True)
    start = grid(spark, sf_dir).select("x", "y", F.when(F.col("cap") > 47, "I").otherwise("S").alias("status"))
    start = start.crossJoin(F.broadcast(runs))
    keys = ("run", *by)
    agent = F.col("run") * (spec.width * spec.height) + models.cell_id(spec)
    reporters = {n.lower(): F.count_if(F.col("status") == n) for n in "SIR"}
    step = lambda c, k: models.sir_step(c, spec, k, 31, beta, 0.1, keys, agent)
    return models.run_collected(start, step, steps, reporters, keys).drop("run")


def _seeds(spark, n):
    return spark.range(n).select(F.col("id").alias("run"), F.col("id").alias("seed"))


_SEEDS = "SELECT range AS run, range AS seed FROM range(4)"


def _whole_sir_sql(runs: str, beta: str, by: str) -> str:
    """The series of synchronous SIR rasters, each until nobody in its run is infected."""
    near = f"(SELECT run, nx AS x, ny AS y, count(*) AS k FROM (SELECT run, {_MOD('x + dx', WIDTH)} AS nx, {_MOD('y + dy', HEIGHT)} AS ny FROM s, {_OFF} WHERE status = 'I') GROUP BY ALL)"
    drawn = child_sql(f"(SELECT *, run * {_CELLS} + y * {WIDTH} + x AS cell FROM s WHERE run IN (SELECT run FROM s WHERE status = 'I'))", 31, "step", "cell")
    rule = _RULE("cell").replace("0.8e0", f"(1 - {beta})")
    start = f"SELECT 0::BIGINT AS step, {by}, run, x, y, CASE WHEN cap > 47 THEN 'I' ELSE 'S' END AS status FROM {GRID}, r"
    return f"WITH RECURSIVE r AS ({runs}), s AS ({start} UNION ALL SELECT step + 1, {by}, c.run, c.x, c.y, {rule} FROM {drawn} c LEFT JOIN {near} USING (run, x, y)) SELECT {by}, step, {_COUNTS} FROM s GROUP BY {by}, step"


@query(_whole_sir_sql(_SEEDS, "0.08e0", "seed"))
def model_sir(spark, sf_dir):
    """Series of four seeded runs, each until nobody is infected."""
    start = grid(spark, sf_dir).select("x", "y", F.when(F.col("cap") > 47, "I").otherwise("S").alias("status"))
    return epidemics.sir_to_the_end(start, _seeds(spark, 4), grid_spec(spark, sf_dir, True), 31, 0.08, 0.1, ("seed",))


@query(f"SELECT seed, max(i) AS peak, arg_max(r, step) AS r_final FROM ({_series_sql(_SEEDS, 3, '0.08e0', 'seed')}) GROUP BY seed")
def ensemble_sir(spark, sf_dir):
    """Peak and final size of each run of an ensemble."""
    series = _sir_series(spark, sf_dir, _seeds(spark, 4), ("seed",), 0.08, 3)
    return series.groupBy("seed").agg(F.max("i").alias("peak"), F.max_by("r", "step").alias("r_final"))


_BETAS = "SELECT a.range * 2 + b.range AS run, (4 * pow(2, a.range) / 100)::DOUBLE AS beta, b.range AS seed FROM range(3) a, range(2) b"


@query(f"SELECT beta, seed, max(i) AS peak, arg_max(r, step) AS r_final FROM ({_series_sql(_BETAS, 2, 'beta', 'beta, seed')}) GROUP BY ALL")
def sweep_sir(spark, sf_dir):
    """Three transmission rates by two seeds; every run advances in the same job."""
    runs = spark.range(6).select(F.col("id").alias("run"), (4 * F.pow(F.lit(2.0), F.expr("id div 2")) / 100).alias("beta"), (F.col("id") % 2).alias("seed"))
    series = _sir_series(spark, sf_dir, runs, ("beta", "seed"), F.col("beta"), 2)
    return series.groupBy("beta", "seed").agg(F.max("i").alias("peak"), F.max_by("r", "step").alias("r_final"))


def _ordered_sql() -> str:
    parts = [f"s0 AS (SELECT x, y, CASE WHEN cap > 47 THEN 'I' ELSE 'S' END AS status FROM {GRID})"]
    for k in range(4):
        near = f"(SELECT nx AS x, ny AS y, count(*) AS k FROM (SELECT x + dx AS nx, y + dy AS ny FROM s{k}, {_OFF} WHERE status = 'I') GROUP BY ALL)"
        drawn = child_sql(f"(SELECT *, y * {WIDTH} + x AS cell FROM s{k})", 32, str(k), "cell")
        rule = _RULE("cell").removesuffix(" AS status")
        parts.append(f"s{k + 1} AS (SELECT c.x, c.y, CASE WHEN c.x % 2 + 2 * (c.y % 2) = {k} THEN {rule} ELSE status END AS status FROM {drawn} c LEFT JOIN {near} USING (x, y))")
    return "WITH " + ", ".join(parts) + " SELECT x, y, status FROM s4"


@query(_ordered_sql())
def sched_ordered(spark, sf_dir):
    """One step in order: agents act in turn and see what was done before them in the same step. Cells of one colour of four are no neighbours, so they act at once."""
    spec = grid_spec(spark, sf_dir)
    state = grid(spark, sf_dir).select("x", "y", F.when(F.col("cap") > 47, "I").otherwise("S").alias("status"))
    turn = lambda k: F.col("x") % 2 + 2 * (F.col("y") % 2) == k
    return models.run(state, lambda c, k: models.sir_step(c, spec, k, 32, 0.2, 0.1, acts=turn(k)), 4)


@query("WITH " + _network_sql(2).removeprefix("WITH ").rsplit(" SELECT", 1)[0] + " " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS step, {_COUNTS} FROM s{k}" for k in range(3)))
def model_network_sir(spark, sf_dir):
    """The series of a synchronous SIR run over the trade network."""
    edges, start = _network(spark, sf_dir)
    reporters = {n.lower(): F.count_if(F.col("status") == n) for n in "SIR"}
    return models.run_collected(start, lambda c, k: models.network_sir_step(c, edges, k, 22, 0.2, 0.1), 2, reporters)


_CROWD = f"(SELECT y * {WIDTH} + x AS idx, x, y, CAST(cap % 2 AS INT) AS grp FROM {GRID} WHERE cap % 10 < 8)"


def _schelling_sql(steps: int, tolerance: str, runs: str) -> str:
    parts = [f"r AS ({runs})", f"a0 AS (SELECT run, tolerance, idx, x, y, grp FROM {_CROWD}, r)"]
    for k in range(steps + 1):
        told = f"(SELECT run, x + dx AS x, y + dy AS y, grp AS g FROM a{k}, {_OFF})"
        parts.append(f"n{k} AS (SELECT a.run, a.tolerance, a.idx, a.x, a.y, a.grp, count(g) AS n, count_if(g = a.grp)::BIGINT AS same FROM a{k} a LEFT JOIN {told} t ON a.run = t.run AND a.x = t.x AND a.y = t.y GROUP BY ALL)")
        drawn = child_sql(f"(SELECT *, run * {_CELLS} + idx AS agent FROM n{k} WHERE n > 0 AND same < {tolerance} * n)", 33, str(k), "agent")
        free = f"(SELECT run, cell, min(idx) AS idx FROM (SELECT run, idx, floor({u01('h')} * {WIDTH} * {HEIGHT})::BIGINT AS cell FROM {drawn}) p WHERE cell < {_CELLS} AND NOT EXISTS (SELECT 1 FROM a{k} o WHERE o.run = p.run AND o.y * {WIDTH} + o.x = p.cell) GROUP BY run, cell)"
        parts.append(f"a{k + 1} AS (SELECT a.run, a.tolerance, a.idx, CAST(coalesce(cell % {WIDTH}, a.x) AS INT) AS x, CAST(coalesce(cell // {WIDTH}, a.y) AS INT) AS y, a.grp FROM a{k} a LEFT JOIN {free} f ON a.run = f.run AND a.idx = f.idx)")
    each = " UNION ALL ".join(f"SELECT run, tolerance, {k}::BIGINT AS step, sum(same)::BIGINT AS same, sum(n)::BIGINT AS n, count_if(n = 0 OR same >= tolerance * n)::BIGINT AS happy FROM n{k} GROUP BY ALL" for k in range(steps + 1))
    return "WITH " + ", ".join(parts) + " " + each


def _schelling(spark, sf_dir, runs, steps):
    """(run, tolerance, step, same, n, happy): like neighbours, neighbours and content agents of each run."""
    spec, cells = grid_spec(spark, sf_dir), grid(spark, sf_dir).select("x", "y", "cap")
    start = cells.where(F.col("cap") % 10 < 8).select(models.cell_id(spec).alias("idx"), "x", "y", (F.col("cap") % 2).cast("int").alias("grp")).crossJoin(F.broadcast(runs))
    by, state, rows = ("run", "tolerance"), start, None
    for k in range(steps + 1):
        seen = populations.alike(state, spec, by)
        one = seen.groupBy(*by).agg(F.sum("same").alias("same"), F.sum("n").alias("n"), F.count_if((F.col("n") == 0) | (F.col("same") >= F.col("tolerance") * F.col("n"))).alias("happy")).withColumn("step", F.lit(k).cast("long"))
        rows = one if rows is None else rows.unionByName(one)
        if k < steps:
            state = models.settled(populations.schelling_step(state, cells, spec, k, 33, F.col("tolerance"), by, F.col("run") * (spec.width * spec.height) + F.col("idx")))
    return rows


_ONE_RUN = "SELECT range AS run, 0.375e0 AS tolerance FROM range(2)"


@query(f"SELECT run AS seed, step, round(same / n, 6) AS similarity, happy FROM ({_schelling_sql(2, 'tolerance', _ONE_RUN)})")
def model_schelling(spark, sf_dir):
    """Similarity and content agents of two seeded runs."""
    rows = _schelling(spark, sf_dir, spark.range(2).select(F.col("id").alias("run"), F.lit(0.375).alias("tolerance")), 2)
    return rows.select(F.col("run").alias("seed"), "step", F.round(F.col("same") / F.col("n"), 6).alias("similarity"), "happy")


_TOLERANCES = "SELECT range AS run, (range + 2) / 8e0 AS tolerance FROM range(3)"


@query(f"SELECT tolerance, same, n, happy FROM ({_schelling_sql(1, 'tolerance', _TOLERANCES)}) WHERE step = 1")
def sweep_schelling(spark, sf_dir):
    """One step for three tolerances."""
    runs = spark.range(3).select(F.col("id").alias("run"), ((F.col("id") + 2) / 8.0).alias("tolerance"))
    return _schelling(spark, sf_dir, runs, 1).where("step = 1").select("tolerance", "same", "n", "happy")


def _sugar(spark, sf_dir, growths, steps):
    """(growth, step, population, wealth) of an ensemble over growth rates on the two-peak terrain."""
    spec, by = grid_spec(spark, sf_dir, True), ("growth",)
    top = F.greatest(models.capacity_band(spec, 0.75, 0.25), models.capacity_band(spec, 0.25, 0.75))
    rates = spark.createDataFrame([(g,) for g in growths], "growth int")
    there = grid(spark, sf_dir).select("x", "y", "cap", models.cell_id(spec).alias("idx"))
    cells = there.select("x", "y", top.alias("cap")).withColumn("sugar", F.col("cap")).crossJoin(F.broadcast(rates))
    agents = there.where(F.col("cap") % 5 == 0).select("idx", "x", "y", (F.col("idx") % 4 + 1).cast("int").alias("vision"), (F.col("idx") % 3 + 1).cast("int").alias("metabolism"), (F.col("idx") % 7 + 3).cast("int").alias("wealth")).crossJoin(F.broadcast(rates))
    report = lambda a, k: a.groupBy(*by).agg(F.count("*").alias("population"), F.sum("wealth").alias("wealth")).withColumn("step", F.lit(k).cast("long"))
    rows = report(agents, 0)
    for k in range(steps):
        agents, cells = (models.settled(x) for x in populations.sugar_step(agents, cells, spec, F.col("growth"), by))
        rows = rows.unionByName(report(agents, k + 1))
    return rows


def _sugar_sql(growths: list[int], steps: int) -> str:
    """CTEs a0 .. a<steps> of agents and c0 .. c<steps> of cells: the rule of populations.sugar_step."""
    band = lambda ax, ay: f"(SELECT CASE WHEN far < 0.18e0 THEN 4 WHEN far < 0.37e0 THEN 3 WHEN far < 0.62e0 THEN 2 WHEN far < 1 THEN 1 ELSE 0 END FROM (SELECT sqrt(pow(x - {ax} * {WIDTH}, 2) + pow(y - {ay} * {HEIGHT}, 2)) / (0.55e0 * least({WIDTH}, {HEIGHT})) AS far))"
    parts = [
        f"r AS (SELECT unnest({growths}) AS growth)", f"base AS MATERIALIZED (SELECT x, y, cap, y * {WIDTH} + x AS idx, greatest({band('0.75e0', '0.25e0')}, {band('0.25e0', '0.75e0')}) AS top FROM {GRID})",
        "c0 AS (SELECT growth, x, y, top AS sugar, top AS cap FROM base, r)", "a0 AS (SELECT growth, idx, x, y, idx % 4 + 1 AS vision, idx % 3 + 1 AS metabolism, idx % 7 + 3 AS wealth FROM base, r WHERE cap % 5 = 0)",
        "axes AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 1), (0, 1, 2), (0, -1, 3)) v(dx, dy, axis))",
    ]
    for k in range(steps):
        parts += [
            f"seen{k} AS (SELECT growth, idx, {_MOD('x + dx * dist', WIDTH)} AS nx, {_MOD('y + dy * dist', HEIGHT)} AS ny, dist, axis FROM a{k}, axes, (SELECT unnest(range(1, 5)) AS dist) WHERE dist <= vision)",
            f"open{k} AS (SELECT s.* FROM seen{k} s LEFT JOIN a{k} a ON a.growth = s.growth AND a.x = s.nx AND a.y = s.ny WHERE a.idx IS NULL UNION ALL SELECT growth, idx, x, y, 0, -1 FROM a{k})",
            f"wish{k} AS (SELECT * FROM (SELECT o.growth, o.idx, nx, ny, row_number() OVER (PARTITION BY o.growth, o.idx ORDER BY sugar DESC, dist, axis) AS k FROM open{k} o JOIN c{k} c ON c.growth = o.growth AND c.x = nx AND c.y = ny) WHERE k = 1)",
            f"won{k} AS (SELECT growth, nx, ny, min(idx) AS idx FROM wish{k} GROUP BY ALL)",
            f"put{k} AS (SELECT a.growth, a.idx, coalesce(nx, x) AS x, coalesce(ny, y) AS y, vision, metabolism, wealth FROM a{k} a LEFT JOIN won{k} w ON w.growth = a.growth AND w.idx = a.idx)",
            f"a{k + 1} AS (SELECT * FROM (SELECT p.growth, idx, p.x, p.y, vision, metabolism, wealth + sugar - metabolism AS wealth FROM put{k} p JOIN c{k} c ON c.growth = p.growth AND c.x = p.x AND c.y = p.y) WHERE wealth > 0)",
            f"c{k + 1} AS (SELECT c.growth, c.x, c.y, least(CASE WHEN p.idx IS NULL THEN sugar ELSE 0 END + c.growth, cap) AS sugar, cap FROM c{k} c LEFT JOIN put{k} p ON p.growth = c.growth AND p.x = c.x AND p.y = c.y)",
        ]
    return "WITH " + ", ".join(parts)


@query(_sugar_sql([1], 2) + " " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS step, count(*) AS population, sum(wealth)::BIGINT AS wealth FROM a{k}" for k in range(3)))
def model_sugarscape(spark, sf_dir):
    return _sugar(spark, sf_dir, [1], 2).select("step", "population", "wealth")


@query(_sugar_sql([1, 2], 1) + " SELECT growth, count(*) AS population, sum(wealth)::BIGINT AS wealth FROM a1 GROUP BY growth")
def sweep_sugarscape(spark, sf_dir):
    return _sugar(spark, sf_dir, [1, 2], 1).where("step = 1").select("growth", "population", "wealth")


def _hunt_sql(steps: int) -> str:
    """Grazers and wolves walk, then each cell's wolves eat as many of its grazers, smallest idx first."""
    parts = [f"s AS {_START}", "g0 AS (SELECT * FROM s WHERE idx % 4 > 0)", "v0 AS (SELECT * FROM s WHERE idx % 4 = 0)"]
    for k in range(steps):
        for name, seed in (("g", 41), ("v", 42)):
            drawn = child_sql(f"{name}{k}", seed, str(k), "idx")
            near = f"(SELECT idx, h, {_MOD('x + dx', WIDTH)} AS nx, {_MOD('y + dy', HEIGHT)} AS ny, row_number() OVER (PARTITION BY idx ORDER BY dy, dx) - 1 AS p FROM {drawn}, {_OFF})"
            to = f"v{k + 1}" if name == "v" else f"m{k}"
            parts.append(f"{to} AS (SELECT idx, CAST(nx AS INT) AS x, CAST(ny AS INT) AS y FROM {near} WHERE p = floor({u01('h')} * 8)::BIGINT)")
        parts.append(f"g{k + 1} AS (SELECT idx, x, y FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY idx) AS k FROM m{k}) LEFT JOIN (SELECT x, y, count(*) AS n FROM v{k + 1} GROUP BY ALL) USING (x, y) WHERE n IS NULL OR k > n)")
    each = " UNION ALL ".join(f"SELECT (SELECT count(*) FROM g{k}) AS grazers, (SELECT count(*) FROM v{k}) AS wolves, {k}::BIGINT AS step" for k in range(steps + 1))
    return "WITH " + ", ".join(parts) + " " + each


@query(_hunt_sql(2))
def model_predator_prey_grid(spark, sf_dir):
    """(step, grazers, wolves): grazers of the customers' places, wolves that eat those they meet."""
    spec, start = _walkers(spark, sf_dir)
    grazers, wolves = start.where("idx % 4 > 0"), start.where("idx % 4 = 0")
    report = lambda k: grazers.agg(F.count("*").alias("grazers")).crossJoin(wolves.agg(F.count("*").alias("wolves"))).withColumn("step", F.lit(k).cast("long"))
    rows = report(0)
    for k in range(2):
        grazers, wolves = populations.hunt_step(grazers, wolves, spec, k, 41)
        rows = rows.unionByName(report(k + 1))
    return rows


_HOURS = ", ".join(f"({d}, {h}, {f!r}e0)" for d, h, f in rules.HOURLY)


@query(f"SELECT x, y, CAST(d.range AS INT) AS day, hour, round((v / 100 + d.range) * share, 6) AS rain FROM {GRID}, range(4) d JOIN (VALUES {_HOURS}) p(pday, hour, share) ON pday = d.range")
def rule_hourly_rain(spark, sf_dir):
    daily = grid(spark, sf_dir).select("x", "y", F.col("v").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("day"))
    rain = rules.hourly_rain(daily.select("x", "y", "day", (F.col("own") / 100 + F.col("day")).alias("rain")))
    return rain.select("x", "y", "day", "hour", F.round("rain", 6).alias("rain"))


@query(f"SELECT x, y FROM {GRID} WHERE cap / 50e0 > 0.245e0 AND x / 20e0 > 0.5e0 AND cap % 7 <> 3 AND v / 1000 > 0.916e0")
def rule_spawn(spark, sf_dir):
    """Cells that may start a flow; a NaN layer never passes."""
    layer = F.when(F.col("cap") % 7 == 3, float("nan")).otherwise(F.col("v") / 1000)
    return grid(spark, sf_dir).where(rules.can_start(F.col("cap") / 50.0, F.col("x") / 20.0, layer, 0.245, 0.916)).select("x", "y")


_SLOPE = "(SELECT x, y, (cap - 10) / 100e0 AS slope, v / 100 AS v, cap / 50e0 AS sed FROM " + GRID + ")"
_CL = lambda e, a, b: f"least(greatest({e}, {a}), {b})"


@query(
    f"""SELECT x, y, round({_CL('CASE WHEN slope > 0.01e0 THEN v + 9.81e0 * slope * ((1 - 0.033e0) * 1.97e0) ELSE v * 0.95e0 END', '0.45e0', '23.5e0')}, 9) AS copiapo,
    round(CASE WHEN slope <= 0 THEN v * 0.95e0 ELSE {_CL('v + 9.81e0 * slope - 0.02e0 * v * v', '0.01e0', '600e0')} END, 9) AS coastal,
    round(CASE WHEN slope <= 0 THEN v * 0.95e0 ELSE {_CL('v + 9.81e0 * (slope - 0.1e0) - 9.81e0 * v * v / 500', '0.01e0', '600e0')} END, 9) AS voellmy FROM {_SLOPE}"""
)
def rule_velocity(spark, sf_dir):
    cells = grid(spark, sf_dir).select("x", "y", ((F.col("cap") - 10) / 100.0).alias("slope"), (F.col("v") / 100).alias("v"))
    v, slope = F.col("v"), F.col("slope")
    laws = {"copiapo": dict(friction=0.033, factor=1.97, critical=0.01, low=0.45, high=23.5), "coastal": dict(friction=0.02), "voellmy": dict(mu=0.1, xi=500.0)}
    return cells.select("x", "y", *[F.round(rules.velocity(law, v, slope, **p), 9).alias(law) for law, p in laws.items()])


@query(f"SELECT x, y, round(CASE WHEN slope > 0.1e0 THEN least(v * (1 + 0.3e0 * greatest(sed, 0)), 9e0 * 1.1e0) ELSE v * CASE WHEN slope > 0.01e0 THEN 0.98e0 ELSE 0.96e0 END END, 6) AS volume FROM {_SLOPE}")
def rule_volume(spark, sf_dir):
    cells = grid(spark, sf_dir)
    out = rules.volume(F.col("v") / 100, F.lit(9.0), (F.col("cap") - 10) / 100.0, F.col("cap") / 50.0, 0.1, 0.3, 1.1, 0.98, 0.96)
    return cells.select("x", "y", F.round(out, 6).alias("volume"))


@query(f"SELECT idx, CAST(range AS INT) AS child, round(px + 2 * cos(range * (2 * pi() / 3)), 5) AS px, round(py + 2 * sin(range * (2 * pi() / 3)), 5) AS py, round((idx % 10 + 1) / 4e0, 6) AS volume, round(0.8e0 * (idx % 5), 6) AS velocity FROM {CUSTOMERS}, range(3)")
def rule_spread(spark, sf_dir):
    flows = customers(spark, sf_dir).withColumns({"volume": (F.col("idx") % 10 + 1).cast("double"), "velocity": (F.col("idx") % 5).cast("double")})
    out = rules.spread(flows, 3, 2.0)
    return out.select("idx", "child", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"), F.round("volume", 6).alias("volume"), F.round("velocity", 6).alias("velocity"))


@query("SELECT step % 24 AS hour, round(least(0.1e0 + 0.9e0 * exp(-pow(least(abs(step % 24 - 22), 24 - abs(step % 24 - 22)), 2) / (2 * 3.5e0 * 3.5e0)), 1e0), 6) AS level, count(*) AS n FROM (SELECT CAST((epoch_us(ts) - 1704067200000000) // 3600000000 AS BIGINT) AS step FROM events) GROUP BY ALL")
def rule_activity(spark, sf_dir):
    level = F.round(rules.activity(F.col("step") % 24, 22.0, 0.9, 3.5, 0.1), 6)
    return panel(spark, sf_dir).groupBy((F.col("step") % 24).alias("hour"), level.alias("level")).agg(F.count("*").alias("n"))


@query(
    f"""WITH z AS (SELECT o_custkey AS idx, o_orderkey % 1000 * 1e0 AS zx, o_orderkey * 7 % 1000 * 1e0 AS zy, o_orderkey % 300 AS step FROM orders)
    SELECT c.idx, round(coalesce(sum(CASE WHEN 300 - step < 168 AND sqrt(pow(px - zx, 2) + pow(py - zy, 2)) < 400 THEN (1 - (300 - step) / 168e0) * (1 - sqrt(pow(px - zx, 2) + pow(py - zy, 2)) / 400) ELSE 0 END), 0), 6) AS risk FROM {CUSTOMERS} c LEFT JOIN z USING (idx) GROUP BY c.idx"""
)
def rule_danger_zones(spark, sf_dir):
    """Risk from each agent's remembered zones at hour 300."""
    zone = F.struct((F.col("o_orderkey") % 1000).cast("double").alias("px"), (F.col("o_orderkey") * 7 % 1000).cast("double").alias("py"), (F.col("o_orderkey") % 300).alias("step"))
    zones = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("idx")).agg(F.sort_array(F.collect_list(zone)).alias("zones"))
    risk = rules.zone_risk(F.col("zones"), F.col("px"), F.col("py"), F.lit(300))
    return customers(spark, sf_dir).join(zones, "idx", "left").select("idx", F.round(F.coalesce(risk, F.lit(0.0)), 6).alias("risk"))


@query(
    f"""WITH z AS (SELECT o_custkey AS idx, o_orderkey % 1000 * 1e0 AS zx, o_orderkey * 7 % 1000 * 1e0 AS zy, o_orderkey % 300 AS step, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 300 DESC, o_orderkey % 1000 DESC, o_orderkey * 7 % 1000 DESC) AS k FROM orders),
    r AS (SELECT c.idx, round(coalesce(sum(CASE WHEN 300 - step < 168 AND sqrt(pow(px - zx, 2) + pow(py - zy, 2)) < 400 THEN (1 - (300 - step) / 168e0) * (1 - sqrt(pow(px - zx, 2) + pow(py - zy, 2)) / 400) ELSE 0 END) FILTER (WHERE k <= 4), 0), 6) AS risk FROM {CUSTOMERS} c LEFT JOIN z USING (idx) GROUP BY c.idx)
    SELECT idx, risk, risk * CASE WHEN idx % 4 = 0 THEN 1.8e0 ELSE 1e0 END > 0.2e0 AS avoids FROM r"""
)
def rule_danger_avoidance(spark, sf_dir):
    """Each agent remembers its four latest zones, and avoids a place whose remembered risk passes its aversion; every fourth feels 1.8 times as much."""
    zone = F.struct((F.col("o_orderkey") % 300).alias("step"), (F.col("o_orderkey") % 1000).cast("double").alias("px"), (F.col("o_orderkey") * 7 % 1000).cast("double").alias("py"))
    zones = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("idx")).agg(rules.remembered(F.sort_array(F.collect_list(zone)), 4).alias("zones"))
    risk = F.round(F.coalesce(rules.zone_risk(F.col("zones"), F.col("px"), F.col("py"), F.lit(300)), F.lit(0.0)), 6)
    felt = customers(spark, sf_dir).join(zones, "idx", "left").select("idx", risk.alias("risk"))
    return felt.select("idx", "risk", rules.avoids(F.col("risk"), F.col("idx") % 4 == 0, F.lit(0.2)).alias("avoids"))


@query(
    f"""WITH n AS (SELECT a.idx, count(*) - 1 AS grp FROM {CUSTOMERS} a, {CUSTOMERS} b WHERE sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) <= 50 GROUP BY a.idx), d AS (SELECT idx, CASE WHEN idx % 3 = 0 THEN idx % 500 END AS dog, CASE WHEN idx % 4 = 0 THEN idx % 40 END AS mother FROM {CUSTOMERS})
    SELECT idx, round(least(greatest(0.26e0 * ((idx % 7) / 7e0) + 0.05e0 * ((idx % 11) / 11e0) + coalesce(-0.20e0 * (1 - dog / 500e0), 0) - 0.03e0 * least(grp / 10e0, 1) + 0.03e0 * (1 - (idx % 100) / 100e0) + CASE WHEN mother < 20 THEN -0.12e0 * (1 - mother / 20e0) ELSE 0 END, 0.02e0), 0.35e0), 6) AS p FROM n JOIN d USING (idx)"""
)
def rule_kill_probability(spark, sf_dir):
    there = customers(spark, sf_dir)
    group = nearest.within(there, there, SPACE, 50.0).select("idx", (F.col("n") - 1).alias("grp"))
    i = F.col("idx")
    p = rules.kill_probability(0.26, (i % 7) / 7.0, (i % 11) / 11.0, F.when(i % 3 == 0, i % 500), F.col("grp"), i % 100, F.when(i % 4 == 0, i % 40))
    return group.select("idx", F.round(p, 6).alias("p"))


@query("SELECT 500::BIGINT AS n, 0::BIGINT AS different")
def sched_partition_invariance(spark, sf_dir):
    """A step dealt out over one and over eight partitions gives the same state."""
    spec = GridSpec(40, 40, True)
    start = spark.range(500).select(F.col("id").alias("idx"), (F.col("id") % 40).cast("int").alias("x"), (F.col("id") * 3 % 40).cast("int").alias("y"))
    one = models.walk_step(start.repartition(1), spec, 0, 5)
    eight = models.walk_step(start.repartition(8, rng.mix64(F.col("idx"))), spec, 0, 5)
    return one.join(eight.withColumnsRenamed({"x": "x8", "y": "y8"}), "idx").agg(F.count("*").alias("n"), F.count_if((F.col("x") != F.col("x8")) | (F.col("y") != F.col("y8"))).alias("different"))
