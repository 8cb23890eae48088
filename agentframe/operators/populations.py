"""Populations on rasters whose agents compete for cells: every agent proposes, the smallest idx gets the cell, one DataFrame transform a step.

States carry the columns ``by`` (configuration, seed), so all runs of an ensemble or a sweep advance together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.operators import grid as g
from agentframe.operators import ranks
from agentframe.operators.grid import GridSpec
from agentframe.operators.models import cell_id, walk_step


def won(proposals: DataFrame, place: list[str]) -> DataFrame:
    """(place, idx) of the smallest idx that proposes each place."""
    return proposals.groupBy(*place).agg(F.min("idx").alias("idx"))


def alike(agents: DataFrame, spec: GridSpec, by: tuple[str, ...] = ()) -> DataFrame:
    """agents (by, idx, x, y, grp) with n, occupied Moore neighbour cells, and same, those of the agent's own group. What agents tell their neighbours goes through one shuffle."""
    told = F.transform(g._targets(spec, g.offsets(g.MOORE)), lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), F.lit(None).cast("long").alias("idx"), F.col("grp").alias("grp")))
    rows = agents.select(*by, F.inline(F.concat(F.array(F.struct("x", "y", F.col("idx").cast("long").alias("idx"), F.lit(-1).alias("grp"))), told)), F.col("grp").alias("own"))
    seen = rows.groupBy(*by, "x", "y").agg(F.max("idx").alias("idx"), F.max(F.when(F.col("idx").isNotNull(), F.col("own"))).alias("mine"), F.count_if(F.col("grp") == 0).alias("n0"), F.count_if(F.col("grp") == 1).alias("n1")).where("idx is not null")
    return seen.select(*by, "idx", "x", "y", F.col("mine").alias("grp"), (F.col("n0") + F.col("n1")).alias("n"), F.when(F.col("mine") == 0, F.col("n0")).otherwise(F.col("n1")).alias("same"))


def schelling_step(agents: DataFrame, cells: DataFrame, spec: GridSpec, step: int, seed: int, tolerance: Column, by: tuple[str, ...] = (), agent: Column | None = None) -> DataFrame:
    """(by, idx, x, y, grp): agents of two groups (0, 1) with fewer than tolerance of their neighbours alike want a random cell, and move if it is free; of two that want one cell, the smaller idx moves."""
    seen = alike(agents, spec, by)
    u = rng.uniform(rng.child_seed(seed, step, F.col("idx") if agent is None else agent))
    wish = F.floor(u * (spec.width * spec.height)).cast("long")
    unhappy = seen.where((F.col("n") > 0) & (F.col("same") < tolerance * F.col("n"))).select(*by, "idx", wish.alias("cell"))
    taken = agents.select(*by, cell_id(spec).alias("cell"))
    free = won(unhappy.join(taken, [*by, "cell"], "left_anti").join(cells.select(cell_id(spec).alias("cell")), "cell", "left_semi"), [*by, "cell"])
    moved = free.select(*by, "idx", (F.col("cell") % spec.width).cast("int").alias("nx"), F.expr(f"cast(cell div {spec.width} as int)").alias("ny"))
    return agents.join(moved, [*by, "idx"], "left").select(*by, "idx", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"), "grp")


def sugar_step(agents: DataFrame, cells: DataFrame, spec: GridSpec, growth: Column, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(agents, cells) after a step of agents (by, idx, x, y, vision, metabolism, wealth) on cells (by, x, y, sugar, cap).

    Each agent wants the free cell with the most sugar along the four axes within its vision, its own included; ties go to the nearest, then by axis. The smaller
    idx gets a cell that several want, the others stay. Agents take the sugar, burn their metabolism and die when nothing is left; then cells grow back.
    """
    seen = g.rays(agents.select(*by, "idx", "x", "y", "vision"), spec, F.col("vision")).select(*by, "idx", "nx", "ny", "dist", "axis")
    seen = seen.join(agents.select(*by, F.col("x").alias("nx"), F.col("y").alias("ny")), [*by, "nx", "ny"], "left_anti")
    seen = seen.unionByName(agents.select(*by, "idx", F.col("x").alias("nx"), F.col("y").alias("ny"), F.lit(0).alias("dist"), F.lit(-1).alias("axis")))
    rich = seen.join(cells.select(*by, F.col("x").alias("nx"), F.col("y").alias("ny"), "sugar"), [*by, "nx", "ny"])
    wish = rich.groupBy(*by, "idx").agg(F.max_by(F.struct("nx", "ny"), F.struct("sugar", -F.col("dist"), -F.col("axis"))).alias("w")).select(*by, "idx", "w.nx", "w.ny")
    got = won(wish, [*by, "nx", "ny"])
    placed = agents.join(got, [*by, "idx"], "left").withColumns({"x": F.coalesce("nx", "x"), "y": F.coalesce("ny", "y")}).drop("nx", "ny")
    fed = placed.join(cells.select(*by, "x", "y", "sugar"), [*by, "x", "y"]).withColumn("wealth", F.col("wealth") + F.col("sugar") - F.col("metabolism"))
    eaten = placed.select(*by, "x", "y", F.lit(0).alias("left"))
    grown = cells.join(eaten, [*by, "x", "y"], "left").withColumn("sugar", F.least(F.coalesce("left", "sugar") + growth, F.col("cap"))).drop("left")
    return fed.where("wealth > 0").select(*agents.columns), grown.select(*cells.columns)


def hunt_step(grazers: DataFrame, wolves: DataFrame, spec: GridSpec, step: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(grazers, wolves) (idx, x, y) after a step: all walk, then each cell's wolves eat as many of its grazers, smallest idx first."""
    grazers, wolves = walk_step(grazers, spec, step, seed), walk_step(wolves, spec, step, seed + 1)
    hungry = wolves.groupBy("x", "y").agg(F.count("*").alias("n"))
    placed = ranks.numbered_within(grazers, ["x", "y"], [F.col("idx")], "k")
    left = placed.join(ranks.sized(hungry), ["x", "y"], "left").where((F.col("k") > F.col("n")) | F.col("n").isNull())
    return left.select("idx", "x", "y"), wolves
