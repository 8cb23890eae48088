"""Optimisers over the parts: which size and price tell a brand's parts apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.operators import optimise as o
from agentframe.operators.models import settled
from agentframe.plans.declare import query
from agentframe.plans.fixtures import table
from agentframe.plans.random_plans import child_sql, mix_sql, u01

BOUNDS, SEED = [(0.0, 50.0), (900.0, 2100.0)], 7
_CASES = "(SELECT p_partkey % 4 AS seed, p_size AS a, floor(p_retailprice / 20) * 20 AS b, p_size > 20 AND p_retailprice < 1500 AND p_partkey % 9 > 0 AS truth, count(*) AS n FROM part GROUP BY ALL)"


def _cases(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 4).alias("seed"), F.col("p_size").alias("a"), (F.floor(F.col("p_retailprice") / 20) * 20).alias("b"), ((F.col("p_size") > 20) & (F.col("p_retailprice") < 1500) & (F.col("p_partkey") % 9 > 0)).alias("truth"))
    return settled(parts.groupBy("seed", "a", "b", "truth").agg(F.count("*").alias("n")))


def _drawn(source: str, ks: list[int]) -> str:
    """source with word base and the uniform draws u<k> of it."""
    for k in ks:
        source = f"(SELECT * EXCLUDE (h), {u01('h')} AS u{k} FROM {mix_sql(source, f'xor(base, {k}::UBIGINT)')})"
    return source


_HERD = "(SELECT 1000 + run AS stream, run, i FROM (SELECT unnest(range(3)) AS run), (SELECT unnest(range(10)) AS i))"
_FIRST = f"(SELECT run, i, u1 * 50 AS x0, 900 + u2 * 1200 AS x1 FROM {_drawn(child_sql(_HERD, SEED, '0', 'stream * 1048576 + i', 'base'), [1, 2])})"
_VALUED = lambda src: f"(SELECT run, i, x0, x1, round(avg(iou) - 0.5e0 * stddev_pop(iou), 9) AS y FROM (SELECT run, i, x0, x1, seed, coalesce(sum(n) FILTER (WHERE a >= x0 AND b <= x1 AND truth) / nullif(sum(n) FILTER (WHERE a >= x0 AND b <= x1 OR truth), 0), 0e0) AS iou FROM {src}, cases GROUP BY ALL) GROUP BY ALL)"


@query(
    f"""WITH cases AS {_CASES}, f AS (SELECT * FROM {_VALUED(_FIRST)}), d AS (SELECT * FROM {_drawn(child_sql(_HERD, SEED, '1', 'stream * 1048576 + i', 'base'), [1, 2, 3, 4, 20, 40])}),
    a AS (SELECT *, r + CASE WHEN r >= i THEN 1 ELSE 0 END AS r1 FROM (SELECT *, floor(u1 * 9)::BIGINT AS r FROM d)),
    b AS (SELECT * EXCLUDE (q), q + CASE WHEN q >= greatest(i, r1) THEN 1 ELSE 0 END AS r2 FROM (SELECT *, p + CASE WHEN p >= least(i, r1) THEN 1 ELSE 0 END AS q FROM (SELECT *, floor(u2 * 8)::BIGINT AS p FROM a))),
    c AS (SELECT *, list_sort([i, r1, r2]) AS t, floor(u3 * 7)::BIGINT AS z0 FROM b), c1 AS (SELECT *, z0 + CASE WHEN z0 >= t[1] THEN 1 ELSE 0 END AS z1 FROM c), c2 AS (SELECT *, z1 + CASE WHEN z1 >= t[2] THEN 1 ELSE 0 END AS z2 FROM c1), e AS (SELECT *, z2 + CASE WHEN z2 >= t[3] THEN 1 ELSE 0 END AS r3, floor(u4 * 2)::BIGINT AS jrand FROM c2),
    tried AS (SELECT e.run, e.i, least(greatest(CASE WHEN u20 < 0.9e0 OR jrand = 0 THEN m.x0 + 0.6e0 * (n.x0 - k.x0) ELSE s.x0 END, 0), 50) AS x0, least(greatest(CASE WHEN u40 < 0.9e0 OR jrand = 1 THEN m.x1 + 0.6e0 * (n.x1 - k.x1) ELSE s.x1 END, 900), 2100) AS x1
      FROM e JOIN f s ON s.run = e.run AND s.i = e.i JOIN f m ON m.run = e.run AND m.i = r1 JOIN f n ON n.run = e.run AND n.i = r2 JOIN f k ON k.run = e.run AND k.i = r3),
    v AS (SELECT * FROM {_VALUED('tried')})
    SELECT f.run, f.i, round(CASE WHEN v.y >= f.y THEN v.x0 ELSE f.x0 END, 6) AS x0, round(CASE WHEN v.y >= f.y THEN v.x1 ELSE f.x1 END, 6) AS x1, round(greatest(v.y, f.y), 6) AS y FROM f JOIN v USING (run, i)"""
)
def optimise_generation(spark, sf_dir):
    """Three runs of differential evolution after one generation, each individual valued by a mean less half a deviation over four seeds."""
    value = o.threshold_iou(_cases(spark, sf_dir), 0.5)
    state = settled(o.start(spark, ["de"], 3, 10, BOUNDS, SEED, value))
    out = o.step(state, 0, 1, BOUNDS, SEED, value)
    return out.select("run", "i", F.round(F.get("x", 0), 6).alias("x0"), F.round(F.get("x", 1), 6).alias("x1"), F.round("y", 6).alias("y"))


@query()
def optimise_grid(spark, sf_dir):
    """The best of every method and run over the parts, and its plain mean over four fresh seeds."""
    found = settled(o.run_grid(spark, o.threshold_iou(_cases(spark, sf_dir), 0.5), list(o.METHODS), 2, BOUNDS, 4, 8, SEED))
    fresh = table(spark, sf_dir, "part").select((F.shiftrightunsigned(rng.child_seed(SEED, 9, F.col("p_partkey")), 62)).alias("seed"), F.col("p_size").alias("a"), (F.floor(F.col("p_retailprice") / 20) * 20).alias("b"), ((F.col("p_size") > 20) & (F.col("p_retailprice") < 1500) & (F.col("p_partkey") % 9 > 0)).alias("truth"))
    again = o.threshold_iou(settled(fresh.groupBy("seed", "a", "b", "truth").agg(F.count("*").alias("n"))), 0.0)(found.withColumn("i", F.lit(0)))
    return found.join(again, ["method", "run"]).select("method", "run", F.round("best", 6).alias("best"), F.round("y", 6).alias("fresh"), "evals")
