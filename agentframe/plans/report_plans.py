"""Reporters and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentframe.operators import collect
from agentframe.operators import grid as g
from agentframe.operators import space as s
from agentframe.plans.declare import query
from agentframe.plans.fixtures import AGENTS, CUSTOMERS, ENS, GRID, HEIGHT, WIDTH, agents, customers, ensemble, grid


@query(f"SELECT grp, count_if(wealth > 500000)::BIGINT AS rich, round(avg(CASE WHEN wealth > 500000 THEN 1e0 ELSE 0e0 END), 6) AS fraction FROM {AGENTS} GROUP BY grp")
def report_fraction(spark, sf_dir):
    rich = F.col("wealth") > 500000
    return agents(spark, sf_dir).groupBy("grp").agg(F.count_if(rich).alias("rich"), F.round(F.avg(rich.cast("double")), 6).alias("fraction"))


_PLACED = f"(SELECT idx, grp, CAST(idx % {WIDTH} AS INT) AS x, CAST(idx // {WIDTH} AS INT) AS y FROM {AGENTS})"


@query(
    f"""WITH a AS {_PLACED}, n AS (SELECT a.idx, count(*) AS occ, count_if(a.grp = b.grp) AS same FROM a JOIN a b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.idx <> b.idx GROUP BY a.idx),
    r AS (SELECT coalesce(same / occ, 1e0) AS r FROM a LEFT JOIN n USING (idx)) SELECT round(avg(r), 6) AS similarity, round(avg(CASE WHEN r >= 0.375e0 THEN 1e0 ELSE 0e0 END), 6) AS happy FROM r"""
)
def report_similarity(spark, sf_dir):
    """Mean share of like neighbours, and the share of agents with 0.375 of them; an agent without neighbours counts 1."""
    placed = agents(spark, sf_dir).select("idx", "grp", (F.col("idx") % WIDTH).cast("int").alias("x"), F.expr(f"cast(idx div {WIDTH} as int)").alias("y"))
    near = g.like_neighbours(placed, g.GridSpec(WIDTH, 1 << 30), "grp")
    r = near.select(F.coalesce(F.try_divide("same", "occ").cast("double"), F.lit(1.0)).alias("r"))
    return r.agg(F.round(F.avg("r"), 6).alias("similarity"), F.round(F.avg((F.col("r") >= 0.375).cast("double")), 6).alias("happy"))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY wealth) AS i, count(*) OVER (PARTITION BY grp) AS n FROM {AGENTS}) SELECT grp, round(CASE WHEN sum(wealth) = 0 THEN 0 ELSE CAST(sum((2 * i - n - 1) * wealth) AS DOUBLE) / (max(n) * CAST(sum(wealth) AS DOUBLE)) END, 6) AS gini FROM r GROUP BY grp")
def report_gini(spark, sf_dir):
    return collect.gini(agents(spark, sf_dir), "grp", "wealth").select("grp", F.round("gini", 6).alias("gini"))


@query(f"SELECT grp, round(avg(wealth), 4) AS mean_wealth FROM {AGENTS} GROUP BY grp")
def report_mean_wealth(spark, sf_dir):
    return agents(spark, sf_dir).groupBy("grp").agg(F.round(F.avg("wealth"), 4).alias("mean_wealth"))


@query(f"SELECT round(sqrt(pow(sum(CASE WHEN l > 0 THEN x / l ELSE 0 END), 2) + pow(sum(CASE WHEN l > 0 THEN y / l ELSE 0 END), 2)) / count(*), 6) AS polarisation FROM (SELECT px - 500 AS x, py - 500 AS y, sqrt(pow(px - 500, 2) + pow(py - 500, 2)) AS l FROM {CUSTOMERS})")
def report_vicsek(spark, sf_dir):
    """Length of the sum of unit headings, relative to their number."""
    ux, uy = s.normalised(F.col("px") - 500, F.col("py") - 500)
    return customers(spark, sf_dir).agg(F.round(s.length(F.sum(ux), F.sum(uy)) / F.count("*"), 6).alias("polarisation"))


@query(f"SELECT round(sum(v), 4) AS total, max(v) AS top, count_if(v > 1200)::BIGINT AS active FROM {GRID}")
def report_field(spark, sf_dir):
    return grid(spark, sf_dir).agg(F.round(F.sum("v"), 4).alias("total"), F.max("v").alias("top"), F.count_if(F.col("v") > 1200).alias("active"))


@query(f"WITH t AS (SELECT max(wealth) AS top FROM {AGENTS}), c AS (SELECT CAST(wealth * 10 // (top + 1) AS INT) AS bin, count(*) AS n FROM {AGENTS}, t GROUP BY 1) SELECT CAST(range AS INT) AS bin, coalesce(n, 0) AS n FROM range(10) LEFT JOIN c ON bin = range")
def report_histogram(spark, sf_dir):
    return collect.histogram(agents(spark, sf_dir), "wealth", 10)


@query(f"SELECT config, seed, max(v) AS peak, min(step) FILTER (WHERE v = top) AS peak_step, arg_max(v, step) AS last_v FROM (SELECT *, max(v) OVER (PARTITION BY config, seed) AS top FROM {ENS}) GROUP BY config, seed")
def series_peak(spark, sf_dir):
    best = F.max_by("step", F.struct("v", -F.col("step")))
    return ensemble(spark, sf_dir).groupBy("config", "seed").agg(F.max("v").alias("peak"), best.alias("peak_step"), F.max_by("v", "step").alias("last_v"))


@query(f"SELECT grp, round(CAST(count_if(wealth % 13 = 0) AS DOUBLE) / count(*) * 100, 6) AS loss_pct FROM {AGENTS} GROUP BY grp")
def report_loss_rate(spark, sf_dir):
    return agents(spark, sf_dir).groupBy("grp").agg(F.round(F.count_if(F.col("wealth") % 13 == 0).cast("double") / F.count("*") * 100, 6).alias("loss_pct"))


@query("WITH RECURSIVE f(step, v) AS (SELECT 0, 0e0 UNION ALL SELECT step + 1, (v + 10) * 0.95e0 FROM f WHERE step < 200) SELECT CAST(step AS BIGINT) AS step, round(v, 3) AS mean_field, round(v - 10 * 0.95e0 / 0.05e0, 3) AS gap FROM f")
def field_fixed_point(spark, sf_dir):
    """The mean field under constant deposits and evaporation, and its gap to the fixed point d (1 - e) / e."""
    keep, d = 0.95, 10.0
    v = d * keep * (1 - F.pow(F.lit(keep), F.col("id"))) / (1 - keep)
    return spark.range(201).select(F.col("id").alias("step"), F.round(v, 3).alias("mean_field"), F.round(v - d * keep / 0.05, 3).alias("gap"))


def _spread_sql(values: str, ddof: int) -> str:
    """The standard deviation of whole millionths from exact sums."""
    return f"round(sqrt((count(*) * sum({values}::HUGEINT * {values}) - sum({values})::HUGEINT * sum({values}))::DOUBLE / (count(*) * (count(*) - {ddof}))) / 1e6, 6)"


def _mean_sql(values: str) -> str:
    return f"CAST((2 * sum({values}) + count(*)) // (2 * count(*)) AS BIGINT) / 1e6"


def _exact(groups, value: str, ddof: int, mean: str, sd: str, *more):
    """Groups with count, mean (to the nearest millionth) and standard deviation of whole millionths, from exact sums. A sample of one has no deviation."""
    wide = F.col(value).cast("decimal(19,0)")
    s = groups.agg(F.count("*").alias("__n"), F.sum(value).alias("__s"), F.sum(wide).alias("__w"), F.sum(wide * wide).alias("__q"), *more)
    scatter = (F.col("__n") * F.col("__q") - F.col("__w") * F.col("__w")).cast("double")
    deviation = F.when(F.col("__n") > ddof, F.round(F.sqrt(scatter / (F.col("__n") * (F.col("__n") - ddof))) / 1e6, 6))
    return s.withColumns({mean: F.expr("(2 * __s + __n) div (2 * __n)") / 1e6, sd: deviation})


@query(f"SELECT config, step, {_mean_sql('micro')} AS mean_v, {_spread_sql('micro', 0)} AS sd_v FROM {ENS} GROUP BY ALL")
def ensemble_summary(spark, sf_dir):
    return _exact(ensemble(spark, sf_dir).groupBy("config", "step"), "micro", 0, "mean_v", "sd_v").select("config", "step", "mean_v", "sd_v")


@query(f"SELECT config, {_mean_sql('micro')} AS mean_v, CASE WHEN count(*) > 1 THEN {_spread_sql('micro', 1)} END AS sd_v, max(v) AS top FROM {ENS} GROUP BY ALL")
def ensemble_summary_sample(spark, sf_dir):
    return _exact(ensemble(spark, sf_dir).groupBy("config"), "micro", 1, "mean_v", "sd_v", F.max("v").alias("top")).select("config", "mean_v", "sd_v", "top")


@query(f"SELECT config, count(*) AS runs, {_mean_sql('peak')} AS mean_peak, {_spread_sql('peak', 0)} AS sd_peak FROM (SELECT config, seed, max(micro) AS peak FROM {ENS} GROUP BY ALL) GROUP BY config")
def sweep_aggregate(spark, sf_dir):
    runs = ensemble(spark, sf_dir).groupBy("config", "seed").agg(F.max("micro").alias("peak"))
    return _exact(runs.groupBy("config"), "peak", 0, "mean_peak", "sd_peak").select("config", F.col("__n").alias("runs"), "mean_peak", "sd_peak")


@query(f"SELECT idx, round(avg(y), 6) AS y FROM (SELECT idx, (CAST((idx * 31 + r * 100000) % 997 AS DOUBLE)) AS y FROM {AGENTS}, range(5) t(r)) GROUP BY idx")
def replicate_mean(spark, sf_dir):
    """The mean outcome over replicates whose seed is base + r * 100000."""
    runs = agents(spark, sf_dir).select("idx", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r"))
    return runs.groupBy("idx").agg(F.round(F.avg(((F.col("idx") * 31 + F.col("r") * 100000) % 997).cast("double")), 6).alias("y"))


@query(f"SELECT x, y, CAST(10 * (cap // 10) AS INT) AS r, CAST(cap * 5 AS INT) AS g, 90 AS b, 255 AS a FROM {GRID} WHERE y < {HEIGHT}")
def viz_palette_join(spark, sf_dir):
    """Cells joined with a palette of their value."""
    palette = spark.range(51).select(F.col("id").cast("int").alias("cap"), (10 * F.expr("id div 10")).cast("int").alias("r"), (F.col("id") * 5).cast("int").alias("g"), F.lit(90).alias("b"), F.lit(255).alias("a"))
    return grid(spark, sf_dir).join(F.broadcast(palette), "cap").select("x", "y", "r", "g", "b", "a")
