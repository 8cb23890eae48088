"""Experiment designs as DataFrames: Latin hypercube, Sobol' points, Saltelli blocks, Morris trajectories, and their indices."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.operators.agents import numbered

# Degree, coefficients and first direction numbers of the first dimensions of the published Joe-Kuo table (dimension 1 is van der Corput's).
DIRECTIONS = [(1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13]), (5, 2, [1, 1, 5, 5, 17]), (5, 4, [1, 1, 5, 5, 5]), (5, 7, [1, 1, 7, 11, 19])]
BITS = 31


def scaled(u: Column, low: float, high: float) -> Column:
    if low >= high:
        raise ValueError("a range needs low < high")
    return F.lit(low) + u * (high - low)


def draw(seed: int, dimension: int, row: Column) -> Column:
    return rng.uniform(rng.child_seed(seed, F.lit(dimension).cast("long"), row.cast("long")))


def latin_hypercube(spark: SparkSession, ranges: list[tuple[float, float]], n: int, seed: int) -> DataFrame:
    """(row, dim, value): in each dimension one point per interval; rows take the intervals in the order of their random words."""
    cells = spark.range(n).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(len(ranges) - 1))).alias("dim"))
    word = rng.child_seed(seed, F.col("dim").cast("long"), F.col("row"))
    cells = cells.withColumn("h", F.shiftrightunsigned(word, 1))
    cells = numbered(cells, [F.col("dim").asc(), F.col("h").asc(), F.col("row").asc()], "__k")
    stratum = F.col("__k") - 1 - F.col("dim") * n
    jitter = rng.uniform(rng.mix64(F.col("h")))
    low, high = (F.element_at(F.array(*[F.lit(float(r[i])) for r in ranges]), F.col("dim") + 1) for i in (0, 1))
    return cells.withColumn("u", (stratum + jitter) / n).select("row", "dim", (low + F.col("u") * (high - low)).alias("value"))


def read_directions(path: str) -> list[tuple[int, int, list[int]]]:
    """The rows of a published table of direction numbers (d, s, a, m_1 .. m_s with a heading), such as the one for 21,201 dimensions, in place of DIRECTIONS."""
    with open(path) as lines:
        rows = [list(map(int, line.split())) for line in lines if line[:1].isdigit()]
    return [(s, a, m) for _, s, a, *m in rows]


def direction_numbers(dimension: int, directions: list[tuple[int, int, list[int]]] = DIRECTIONS) -> list[int]:
    """BITS direction numbers of a dimension from 0, by the primitive polynomial's recurrence."""
    if dimension == 0:
        return [1 << (BITS - 1 - i) for i in range(BITS)]
    s, a, m = directions[dimension - 1]
    v = [m[i] << (BITS - 1 - i) for i in range(min(s, BITS))]
    for i in range(s, BITS):
        new = v[i - s] ^ (v[i - s] >> s)
        for k in range(1, s):
            if (a >> (s - 1 - k)) & 1:
                new ^= v[i - k]
        v.append(new)
    return v


def sobol_point(i: Column, dimension: int, directions: list[tuple[int, int, list[int]]] = DIRECTIONS) -> Column:
    """The i-th Sobol' coordinate, an error from 2 ** BITS on: direction numbers of the Gray code's bits, combined by exclusive or. No state, no join."""
    i = F.when(i < (1 << BITS), i).otherwise(F.raise_error(F.lit("beyond the last point")).cast("long"))
    gray = i.bitwiseXOR(F.shiftright(i, 1))
    bits = [F.when(F.shiftright(gray, j).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(v).cast("long")).otherwise(F.lit(0).cast("long")) for j, v in enumerate(direction_numbers(dimension, directions))]
    return reduce(lambda x, y: x.bitwiseXOR(y), bits).cast("double") / float(1 << BITS)


def sobol_design(spark: SparkSession, params: int, n: int, directions: list[tuple[int, int, list[int]]] = DIRECTIONS) -> DataFrame:
    """(row, a0.., b0..): 2 * params coordinates after a skip of the next power of two."""
    if not 0 < 2 * params <= len(directions) + 1:
        raise ValueError("too many parameters for the table")
    skip = 1 << max(0, (n - 1).bit_length())
    i = F.col("id") + skip
    named = [sobol_point(i, k, directions).alias(f"{'ab'[k // params]}{k % params}") for k in range(2 * params)]
    return spark.range(n).select(F.col("id").alias("row"), *named)


def saltelli(design: DataFrame, params: int) -> DataFrame:
    """(row, block, x0..): blocks A, B and AB_i, where AB_i is A with parameter i from B. A and AB_i share a row's seed."""
    a, b = [F.col(f"a{k}") for k in range(params)], [F.col(f"b{k}") for k in range(params)]
    blocks = [("A", a), ("B", b)] + [(f"AB{i}", [b[k] if k == i else a[k] for k in range(params)]) for i in range(params)]
    rows = F.array(*[F.struct(F.lit(name).alias("block"), *[c.alias(f"x{k}") for k, c in enumerate(cols)]) for name, cols in blocks])
    return design.select("row", F.inline(rows))


def sobol_indices(y: DataFrame, params: int, *by: str) -> DataFrame:
    """(by, param, s1, st) of (by, row, block, y): first-order and total indices; 0 for a constant model, NaN for an infinite variance."""
    wide = y.groupBy(*by, "row").pivot("block", ["A", "B", *[f"AB{i}" for i in range(params)]]).agg(F.first("y"))
    long = wide.select(*by, F.col("A").alias("ya"), F.col("B").alias("yb"), F.inline(F.array(*[F.struct(F.lit(i).alias("param"), F.col(f"AB{i}").alias("yab")) for i in range(params)])))
    n = F.count("*")
    mean = (F.sum("ya") + F.sum("yb")) / (2 * n)
    var = (F.sum(F.col("ya") * F.col("ya")) + F.sum(F.col("yb") * F.col("yb"))) / (2 * n) - mean * mean
    s = long.groupBy(*by, "param").agg(var.alias("var"), F.avg(F.col("yb") * (F.col("yab") - F.col("ya"))).alias("f"), (F.avg(F.pow(F.col("ya") - F.col("yab"), F.lit(2))) / 2).alias("t"))
    of = lambda c: F.when(F.isnan("var") | (F.abs("var") == float("inf")), float("nan")).when(F.col("var") <= 0, 0.0).otherwise(F.col(c) / F.col("var"))
    return s.select(*by, "param", of("f").alias("s1"), of("t").alias("st"))


def bootstrap(y: DataFrame, params: int, n: int, resamples: int, seed: int) -> DataFrame:
    """(param, s1_low, s1_high, st_low, st_high): nearest-rank 2.5 and 97.5 percentiles over resampled rows."""
    spark = y.sparkSession
    picks = spark.range(resamples).select(F.col("id").alias("boot"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("k"))
    picks = picks.withColumn("row", rng.below(rng.child_seed(seed, F.col("boot"), F.col("k")), F.lit(n)))
    sampled = picks.join(y, "row").select("boot", F.col("k").alias("row"), "block", "y")
    each = sobol_indices(sampled, params, "boot")
    at = lambda c, p: F.element_at(F.sort_array(F.collect_list(c)), int((resamples - 1) * p + 0.5) + 1)
    return each.groupBy("param").agg(at("s1", 0.025).alias("s1_low"), at("s1", 0.975).alias("s1_high"), at("st", 0.025).alias("st_low"), at("st", 0.975).alias("st_high"))


def morris(spark: SparkSession, params: int, trajectories: int, levels: int, seed: int) -> DataFrame:
    """(traj, k, dim, x0..): each trajectory starts on a low level and adds delta to one parameter at a time, in random order; dim is the one that moved (-1 at the start)."""
    if levels < 2:
        raise ValueError("levels is at least 2")
    delta, top = levels / (2.0 * (levels - 1)), (levels - 2) // 2 + 1
    base = spark.range(trajectories).withColumnRenamed("id", "traj")
    order = F.array_sort(F.array(*[F.struct(F.shiftrightunsigned(rng.child_seed(seed, F.lit(100 + d).cast("long"), F.col("traj")), 1).alias("h"), F.lit(d).alias("d")) for d in range(params)]))
    starts = [(rng.below(rng.child_seed(seed, F.lit(d).cast("long"), F.col("traj")), F.lit(top)) / float(levels - 1)).alias(f"s{d}") for d in range(params)]
    rows = base.select("traj", F.transform(order, lambda o: o["d"]).alias("order"), *starts).select("*", F.explode(F.sequence(F.lit(0), F.lit(params))).alias("k"))
    moved = [(F.col(f"s{d}") + F.when(F.array_position("order", d) <= F.col("k"), delta).otherwise(0.0)).alias(f"x{d}") for d in range(params)]
    return rows.select("traj", "k", F.coalesce(F.get("order", F.col("k") - 1), F.lit(-1)).alias("dim"), *moved)


def morris_effects(runs: DataFrame, delta: float) -> DataFrame:
    """(dim, mu, mu_star, sigma) of (traj, k, dim, y); sigma is NaN for a single effect."""
    w = Window.partitionBy("traj").orderBy("k")
    ee = runs.withColumn("ee", (F.col("y") - F.lag("y").over(w)) / delta).where("k > 0")
    return ee.groupBy("dim").agg(F.avg("ee").alias("mu"), F.avg(F.abs("ee")).alias("mu_star"), F.coalesce(F.stddev_samp("ee"), F.lit(float("nan"))).alias("sigma"))


def evaluate_all(points: DataFrame, outcome: Callable[[DataFrame], DataFrame], params: int) -> DataFrame:
    """(param, s1, st) of a model over Saltelli points (row, block, x0..): outcome takes (row, block, x0..) and adds y, for all points at once."""
    return sobol_indices(outcome(points).select("row", "block", "y"), params)
