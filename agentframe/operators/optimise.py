"""Optimisers as tables: all methods and runs advance together, one job a generation.

A row is an individual of a population, keyed by (method, run, i). Partners, steps and acceptance are drawn from counters of (seed, generation, individual), so results do not depend on
where rows lie. The objective takes trials (method, run, i, x) and gives y, as an aggregate over some table; populations are small, tables may be large.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.operators.models import settled

# Factors and rates of the methods.
DE_FACTOR, DE_CROSS = 0.6, 0.9
GA_BLEND, GA_RATE, GA_STEP = 0.5, 0.2, 0.1
PSO_INERTIA, PSO_PULL = 0.729, 1.49445
SA_STEP, SA_HEAT, SA_END = 0.1, 0.1, 0.001
METHODS = ("de", "de_serial", "ga", "pso", "sa", "gwo")
KEYS = ("method", "run", "i")
Objective = Callable[[DataFrame], DataFrame]
Bounds = list[tuple[float, float]]


def base(seed: int, generation: int) -> Column:
    """A word for each individual and generation; runs of one method have the stream 1000 * (method + 1) + run."""
    place = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    return rng.child_seed(seed, generation, (place * 1000 + F.col("run")) * (1 << 20) + F.col("i"))


def _drawn(rows: DataFrame, word: Column, draws: int) -> DataFrame:
    """rows with __u: uniform draws 0, 1, 2, ... of the word, one expression for all."""
    ks = F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))
    return rows.withColumn("__base", word).withColumn("__u", F.transform(ks, lambda k: rng.uniform(rng.mix64(F.col("__base").bitwiseXOR(k)))))


def _u(k: int) -> Column:
    return F.get("__u", k)


def _below(k: int, bound: Column) -> Column:
    return F.floor(_u(k) * bound).cast("long")


def _normal(k: int, sd: float) -> Column:
    """A normal deviate from draws k and k + 1."""
    return sd * F.sqrt(-2 * F.log(F.greatest(_u(k), F.lit(1e-300)))) * F.cos(2 * math.pi * _u(k + 1))


def _apart(r: Column, taken: list[Column]) -> Column:
    """The r-th individual of those that are not taken."""
    order = F.array_sort(F.array(*taken))
    for k in range(len(taken)):
        r = r + (r >= F.get(order, k)).cast("long")
    return r


def start(spark: SparkSession, methods: list[str], runs: int, population: int, bounds: Bounds, seed: int, objective: Objective) -> DataFrame:
    """(method, run, i, x, y, own, own_y, speed): uniform populations with their values."""
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown method {', '.join(sorted(unknown))}")
    if population < 4:
        raise ValueError("a population has four individuals at least")
    rows = spark.range(len(methods) * runs * population).select(
        F.get(F.array(*[F.lit(m) for m in methods]), F.expr(f"cast(id div {runs * population} as int)")).alias("method"), F.expr(f"id div {population} % {runs}").alias("run"), (F.col("id") % population).alias("i"))
    rows = _drawn(rows, base(seed, 0), len(bounds) + 1)
    x = F.array(*[F.lit(a) + _u(k + 1) * (b - a) for k, (a, b) in enumerate(bounds)])
    rows = settled(rows.select(*KEYS, x.alias("x")))
    valued = rows.join(objective(rows), list(KEYS))
    return valued.select(*KEYS, "x", "y", F.col("x").alias("own"), F.col("y").alias("own_y"), F.transform("x", lambda v: v * 0.0).alias("speed"))


def trials(state: DataFrame, generation: int, generations: int, bounds: Bounds, seed: int) -> DataFrame:
    """state with trial and its speed, of the individuals that move: all of them, or one a generation where each sees the last one's result (de_serial)."""
    d = len(bounds)
    top = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("y", "i", "x")))), 1, 3)
    herd = state.groupBy("method", "run").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("herd"), F.max_by("own", F.struct("own_y", -F.col("i"))).alias("best"), top.alias("top"))
    rows = _drawn(state.join(herd, ["method", "run"]), base(seed, generation + 1), 20 + 20 * d).withColumn("n", F.size("herd").cast("long"))
    rows = rows.where((F.col("method") != "de_serial") | (F.col("i") == F.lit(generation) % F.col("n")))
    r1 = _apart(_below(1, F.col("n") - 1), [F.col("i")])
    rows = rows.withColumn("r1", r1).withColumn("r2", _apart(_below(2, F.col("n") - 2), [F.col("i"), F.col("r1")]))
    rows = rows.withColumn("r3", _apart(_below(3, F.col("n") - 3), [F.col("i"), F.col("r1"), F.col("r2")])).withColumn("jrand", _below(4, F.lit(d)))
    duel = [[F.get("herd", _below(5 + 2 * p + q, F.col("n")).cast("int")) for q in (0, 1)] for p in (0, 1)]
    rows = rows.withColumns({f"p{p}": F.when(pair[0]["y"] > pair[1]["y"], pair[0]["x"]).otherwise(pair[1]["x"]) for p, pair in enumerate(duel)})
    cool, other = generation / max(1, generations), lambda r, k: F.get(F.get("herd", F.col(r).cast("int"))["x"], k)
    moves: dict[str, list[Column]] = {m: [] for m in METHODS}
    speeds = []
    for k, (a, b) in enumerate(bounds):
        x, width, at = F.get("x", k), b - a, 20 + 20 * k
        cross = F.when((_u(at) < DE_CROSS) | (F.col("jrand") == k), other("r1", k) + DE_FACTOR * (other("r2", k) - other("r3", k))).otherwise(x)
        low, high = F.least(F.get("p0", k), F.get("p1", k)), F.greatest(F.get("p0", k), F.get("p1", k))
        child = low - GA_BLEND * (high - low) + _u(at + 1) * (1 + 2 * GA_BLEND) * (high - low)
        child = child + F.when(_u(at + 2) < GA_RATE, _normal(at + 3, GA_STEP * width)).otherwise(0.0)
        speed = PSO_INERTIA * F.get("speed", k) + PSO_PULL * _u(at + 5) * (F.get("own", k) - x) + PSO_PULL * _u(at + 6) * (F.get("best", k) - x)
        pull = 2 * (1 - cool)
        led = [F.get(F.get("top", w)["x"], k) - (2 * pull * _u(at + 9 + w) - pull) * F.abs(2 * _u(at + 12 + w) * F.get(F.get("top", w)["x"], k) - x) for w in range(3)]
        steps = {"de": cross, "de_serial": cross, "ga": F.when(F.col("i") == 0, F.get("best", k)).otherwise(child), "pso": x + speed, "sa": x + _normal(at + 7, SA_STEP * width), "gwo": (led[0] + led[1] + led[2]) / 3}
        for m, move in steps.items():
            moves[m].append(F.least(F.greatest(move, F.lit(a)), F.lit(b)))
        speeds.append(speed)
    chosen = None
    for m, move in moves.items():
        chosen = F.when(F.col("method") == m, F.array(*move)) if chosen is None else chosen.when(F.col("method") == m, F.array(*move))
    return rows.select(*KEYS, chosen.alias("trial"), F.when(F.col("method") == "pso", F.array(*speeds)).otherwise(F.col("speed")).alias("moved"), _u(9).alias("chance"))


def step(state: DataFrame, generation: int, generations: int, bounds: Bounds, seed: int, objective: Objective) -> DataFrame:
    """state after one generation: the objective is asked once, for all trials of all runs."""
    tried = settled(trials(state, generation, generations, bounds, seed))
    valued = tried.join(objective(tried.select(*KEYS, F.col("trial").alias("x"))).withColumnRenamed("y", "new"), list(KEYS))
    heat = SA_HEAT * SA_END ** (generation / max(1, generations))
    up = F.col("new") >= F.col("y")
    taken = F.when(F.col("method").isin("de", "de_serial"), up).when(F.col("method") == "sa", up | (F.col("chance") < F.exp(F.least(F.lit(0.0), (F.col("new") - F.col("y")) / heat)))).otherwise(True)
    out = state.join(valued, list(KEYS), "left").withColumn("taken", F.col("trial").isNotNull() & taken)
    put = lambda a, b: F.when(F.col("taken"), F.col(a)).otherwise(F.col(b)).alias(b)
    out = out.select(*KEYS, put("trial", "x"), put("new", "y"), "own", "own_y", F.coalesce("moved", "speed").alias("speed"))
    better = F.col("y") > F.col("own_y")
    return out.select(*KEYS, "x", "y", F.when(better, F.col("x")).otherwise(F.col("own")).alias("own"), F.greatest("y", "own_y").alias("own_y"), "speed")


def run_grid(spark: SparkSession, objective: Objective, methods: list[str], runs: int, bounds: Bounds, generations: int, population: int, seed: int) -> DataFrame:
    """(method, run, best, x, evals) of every method and run: the best value met and where."""
    state = settled(start(spark, methods, runs, population, bounds, seed, objective))
    for g in range(generations):
        state = settled(step(state, g, generations, bounds, seed, objective))
    evals = population + F.when(F.col("method") == "de_serial", generations).otherwise(generations * population)
    return state.groupBy("method", "run").agg(F.max("own_y").alias("best"), F.max_by("own", F.struct("own_y", -F.col("i"))).alias("x")).select("method", "run", "best", "x", evals.cast("long").alias("evals"))


def robust(values: DataFrame, value: str, spread: float = 1.0) -> DataFrame:
    """(method, run, i, y): the mean of an individual's values over seeds, less spread times their deviation, to nine places, so the order of additions decides no comparison."""
    return values.groupBy(*KEYS).agg(F.round(F.avg(value) - spread * F.stddev_pop(value), 9).alias("y"))


def threshold_iou(cases: DataFrame, spread: float) -> Objective:
    """How well two thresholds tell true cases: predicted are those with a >= x[0] and b <= x[1]; the overlap with the true ones, for each seed of cases (seed, a, b, truth, n), less spread deviations.

    cases are counts of a table's rows by their values, so what a generation reads does not grow with the table.
    """

    def objective(tried: DataFrame) -> DataFrame:
        hit = (F.col("a") >= F.get("x", 0)) & (F.col("b") <= F.get("x", 1))
        n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
        seen = cases.crossJoin(F.broadcast(tried.select(*KEYS, "x"))).groupBy(*KEYS, "seed").agg(n(hit & F.col("truth")).alias("tp"), n(hit | F.col("truth")).alias("any"))
        return robust(seen.withColumn("iou", F.when(F.col("any") > 0, F.col("tp") / F.col("any")).otherwise(0.0)), "iou", spread)

    return objective
