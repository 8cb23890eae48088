"""Agent-table and scheduling queries over customers as agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.operators import agents as a
from agentframe.operators import collect, models, paths, ranks
from agentframe.plans.declare import query
from agentframe.plans.fixtures import AGENTS, PANEL, agents, panel, table
from agentframe.plans.random_plans import child_sql

_DEAD = f"(SELECT idx, gen, wealth AS seq FROM {AGENTS} WHERE wealth % 7 = 0)"
_BORN = "(SELECT o_orderkey AS seq, 'NEW' AS grp, CAST(o_orderkey % 100 AS BIGINT) AS wealth FROM orders WHERE o_orderkey % 29 = 0)"
_TOP = f"(SELECT max(idx) FROM {AGENTS})"
_SLOTS = f"(SELECT row_number() OVER (ORDER BY seq DESC, idx) AS k, idx, gen + 1 AS gen FROM {_DEAD})"
_PLACED = f"(SELECT coalesce(s.idx, b.k - (SELECT count(*) FROM {_DEAD}) + {_TOP}) AS idx, coalesce(s.gen, 0) AS gen, grp, wealth FROM (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM {_BORN}) b LEFT JOIN {_SLOTS} s USING (k))"


def _dead(there):
    return there.where("wealth % 7 = 0").select("idx", "gen", F.col("wealth").alias("seq"))


def _born(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 29 = 0")
    return rows.select(F.col("o_orderkey").alias("seq"), F.lit("NEW").alias("grp"), (F.col("o_orderkey") % 100).alias("wealth"))


@query(f"SELECT idx, CAST(gen AS INT) AS gen, grp, wealth FROM {_PLACED}")
def agent_slot_reuse(spark, sf_dir):
    """Births into the slots that deaths freed, last freed first, then new slots."""
    there = agents(spark, sf_dir)
    top = there.agg(F.max("idx")).first()[0]
    return a.insert(there.limit(0), a.freed(_dead(there)), _born(spark, sf_dir), top)


@query(f"SELECT q.idx, q.gen, coalesce(wealth, -1) AS wealth FROM (SELECT o_custkey AS idx, CAST(o_orderkey % 2 AS INT) AS gen, o_orderkey FROM orders) q LEFT JOIN {AGENTS} s ON s.idx = q.idx AND s.gen = q.gen")
def agent_lookup_stale(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("idx"), (F.col("o_orderkey") % 2).cast("int").alias("gen"))
    return a.lookup(agents(spark, sf_dir), ids).select("idx", "gen", F.coalesce("wealth", F.lit(-1).cast("long")).alias("wealth"))


@query(f"SELECT * FROM {AGENTS} WHERE wealth % 7 <> 0")
def agent_deferred_removal(spark, sf_dir):
    there = agents(spark, sf_dir)
    return a.remove(there, _dead(there))


@query(f"SELECT idx, gen FROM {AGENTS} WHERE wealth % 7 <> 0")
def agent_live_ids(spark, sf_dir):
    there = agents(spark, sf_dir)
    return a.remove(there, _dead(there)).select("idx", "gen").orderBy("idx")


@query(f"SELECT idx, CAST(gen AS INT) AS gen, grp, wealth FROM {AGENTS} WHERE wealth % 7 <> 0 UNION ALL SELECT idx, gen, grp, wealth FROM {_PLACED}")
def agent_demography(spark, sf_dir):
    there = agents(spark, sf_dir)
    top = there.agg(F.max("idx")).first()[0]
    return a.demography(there, _dead(there), _born(spark, sf_dir), top)


@query(f"SELECT idx, CASE grp WHEN 'BUILDING' THEN wealth * 2 WHEN 'MACHINERY' THEN wealth - 5 WHEN 'FURNITURE' THEN 0 ELSE wealth END AS wealth FROM {AGENTS}")
def agent_kind_dispatch(spark, sf_dir):
    w = F.col("wealth")
    rules = {"BUILDING": w * 2, "MACHINERY": w - 5, "FURNITURE": F.lit(0).cast("long")}
    return agents(spark, sf_dir).select("idx", a.dispatch(F.col("grp"), rules, w).alias("wealth"))


@query(f"SELECT idx, (SELECT sum(wealth) FROM {AGENTS})::BIGINT AS peers, wealth FROM {AGENTS}")
def peers_global_sum(spark, sf_dir):
    """Each agent reads the same snapshot of all its peers."""
    there = agents(spark, sf_dir)
    return there.crossJoin(F.broadcast(there.agg(F.sum("wealth").alias("peers")))).select("idx", "peers", "wealth")


@query(f"SELECT idx, wealth - (SELECT min(wealth) FROM {AGENTS} o WHERE o.grp = s.grp) AS gap FROM {AGENTS} s")
def sched_peers(spark, sf_dir):
    there = agents(spark, sf_dir)
    low = there.groupBy("grp").agg(F.min("wealth").alias("low"))
    return there.join(low, "grp").select("idx", (F.col("wealth") - F.col("low")).alias("gap"))


@query(f"SELECT idx, row_number() OVER (PARTITION BY grp ORDER BY h >> 1, idx)::INT AS turn FROM {child_sql(AGENTS, 1, '3', 'idx')}")
def sched_random_order(spark, sf_dir):
    """Each step's activation order within a group: by the agents' random words of that step."""
    there = agents(spark, sf_dir).withColumn("h", F.shiftrightunsigned(rng.child_seed(1, F.lit(3).cast("long"), F.col("idx")), 1))
    return ranks.numbered_within(there, ["grp"], [F.col("h"), F.col("idx")], "turn").select("idx", F.col("turn").cast("int").alias("turn"))


@query(f"WITH one AS (SELECT idx, grp, wealth + 1 AS w FROM {AGENTS}), two AS (SELECT *, max(w) OVER (PARTITION BY grp) AS top FROM one) SELECT idx, w * 10 + (w = top)::INT AS counter FROM two")
def sched_staged(spark, sf_dir):
    """Three stages, each a full sweep that sees all of the stage before."""
    one = agents(spark, sf_dir).select("idx", "grp", (F.col("wealth") + 1).alias("w"))
    two = one.join(one.groupBy("grp").agg(F.max("w").alias("top")), "grp")
    return two.select("idx", (F.col("w") * 10 + (F.col("w") == F.col("top")).cast("int")).alias("counter"))


@query(f"SELECT step, count(*) AS n, round(sum(value), 4) AS total FROM {PANEL} WHERE step % 6 = 0 GROUP BY step")
def series_stride(spark, sf_dir):
    return collect.every(panel(spark, sf_dir), 6).groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT step, 'value' AS reporter, idx, value FROM (SELECT step, idx, round(sum(value), 6) AS value FROM {PANEL} GROUP BY ALL) UNION ALL SELECT step, 'events' AS reporter, idx, n FROM (SELECT step, idx, CAST(count(*) AS DOUBLE) AS n FROM {PANEL} GROUP BY ALL)")
def agent_panel(spark, sf_dir):
    state = panel(spark, sf_dir).groupBy("step", "idx").agg(F.round(F.sum("value"), 6).alias("v"), F.count("*").cast("double").alias("n"))
    return collect.panel(state, ["step", "idx"], {"value": F.col("v"), "events": F.col("n")})


@query(f"SELECT step, CAST(count(*) AS DOUBLE) AS n, round(avg(value), 6) AS mean, max(value) AS top FROM {PANEL} GROUP BY step")
def reporter_series(spark, sf_dir):
    return collect.series(panel(spark, sf_dir), {"n": F.count("*"), "mean": F.round(F.avg("value"), 6), "top": F.max("value")})


_MOVES = "(SELECT o_custkey AS idx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step, CAST(o_orderkey * 37 % 801 - 400 AS DOUBLE) AS dx, CAST(o_orderkey * 91 % 601 - 300 AS DOUBLE) AS dy FROM orders)"
_CLAMP = lambda c, d, n: f"least(greatest(w.{c} + m.{d}, 0), {n})"


@query(
    f"""WITH RECURSIVE m AS {_MOVES}, w AS (SELECT DISTINCT idx, CAST(0 AS BIGINT) AS step, 500e0 AS px, 400e0 AS py, 0e0 AS way, CAST(0 AS BIGINT) AS hits FROM m UNION ALL
    SELECT m.idx, m.step, {_CLAMP('px', 'dx', 1000)}, {_CLAMP('py', 'dy', 800)}, w.way + abs({_CLAMP('px', 'dx', 1000)} - w.px) + abs({_CLAMP('py', 'dy', 800)} - w.py),
    w.hits + CASE WHEN {_CLAMP('px', 'dx', 1000)} <> w.px + m.dx OR {_CLAMP('py', 'dy', 800)} <> w.py + m.dy THEN 1 ELSE 0 END FROM w JOIN m ON m.idx = w.idx AND m.step = w.step + 1) SELECT * FROM w WHERE step > 0"""
)
def agent_paths(spark, sf_dir):
    """Each customer's walk by its orders, stopped at the edges: a table function over ordered partitions."""
    orders = table(spark, sf_dir, "orders")
    moves = ranks.numbered_within(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "step").select(
        F.col("o_custkey").alias("idx"), "step", (F.col("o_orderkey") * 37 % 801 - 400).cast("double").alias("dx"), (F.col("o_orderkey") * 91 % 601 - 300).cast("double").alias("dy"))
    return paths.follow(moves, 1000.0, 800.0)


@query(
    f"""WITH RECURSIVE w AS (SELECT 0 AS step, idx, wealth FROM {AGENTS} UNION ALL SELECT step + 1, idx, (wealth + 10) // 2 FROM w WHERE step < 12 AND wealth >= 50),
    ended AS (SELECT min(step) AS last FROM (SELECT step, max(wealth) AS top FROM w GROUP BY step) WHERE top < 100000)
    SELECT CAST(step AS BIGINT) AS step, count(*) AS agents, CAST(sum(wealth) AS BIGINT) AS wealth FROM w, ended WHERE step <= last AND (step = 0 OR wealth >= 50) AND (step % 2 = 0 OR step = last) GROUP BY step"""
)
def sched_until_finished(spark, sf_dir):
    """Wealth is halved until nobody has 100,000; a hook before each step gives ten to all, one after it drops the poor; every second step and the last are collected."""
    start = agents(spark, sf_dir).select("idx", "wealth")
    _, series = models.simulate(
        start, lambda s, _: s.withColumn("wealth", F.expr("wealth div 2")), 12, finished=lambda s: F.max("wealth") < 100000, before=lambda s, _: s.withColumn("wealth", F.col("wealth") + 10),
        after=lambda s, _: s.where("wealth >= 50"), reporters={"agents": F.count("*"), "wealth": F.sum("wealth")}, stride=2)
    return series
