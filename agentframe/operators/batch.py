"""Ensembles, sweeps and optimisers: one task row per (configuration, seed), evaluated where Spark puts it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tasks(configs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every configuration with every seed: the stated design of a sweep, its size the product of two short lists."""
    return configs.crossJoin(F.broadcast(seeds))


def run_all(table: DataFrame, kernel: Callable[[dict], list[tuple]], keys: list[str], columns: list[str], schema: str, parallel: int | None = None) -> DataFrame:
    """(keys, columns) for each row of table: kernel gets the row as a dict and returns rows. Rows are dealt out evenly, so long runs do not queue behind each other."""
    table = table.repartition(parallel or table.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                out = pd.DataFrame(kernel(row), columns=columns)
                for k in reversed(keys):
                    out.insert(0, k, row[k])
                yield out

    return table.mapInPandas(run, schema)


def maximise(spark: SparkSession, evaluate: Callable[[DataFrame], DataFrame], bounds: list[tuple[float, float]], generations: int, population: int, seed: int, method: str = "de") -> tuple[list[float], float]:
    """The best point and value found. evaluate takes (id, x: array of double) and gives (id, value): each generation is one Spark job over the population.

    Methods: de (differential evolution), ga (tournament, blend crossover, elitism), pso (particle swarm), gwo (grey wolves), sa (parallel annealing chains).
    """
    rng, low, high = np.random.default_rng(seed), np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    d = len(bounds)

    def values(x: np.ndarray) -> np.ndarray:
        frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>")
        got = {r.id: r.value for r in evaluate(frame).collect()}
        return np.array([got[i] for i in range(len(x))])

    x = low + rng.random((population, d)) * (high - low)
    y = values(x)
    best, top = x[y.argmax()].copy(), float(y.max())
    own, own_y, speed = x.copy(), y.copy(), np.zeros_like(x)
    for g in range(generations):
        # The factors and rates of the methods, here and below.
        if method == "de":
            pick = np.array([rng.choice(population, 3, replace=False) for _ in range(population)])
            trial = x[pick[:, 0]] + 0.6 * (x[pick[:, 1]] - x[pick[:, 2]])
            cross = rng.random((population, d)) < 0.9
            cross[np.arange(population), rng.integers(0, d, population)] = True
            trial = np.where(cross, trial, x)
        elif method == "ga":
            duel = rng.integers(0, population, (2, population, 2))
            parents = [np.where((y[p[:, 0]] > y[p[:, 1]])[:, None], x[p[:, 0]], x[p[:, 1]]) for p in duel]
            lo, hi = np.minimum(*parents), np.maximum(*parents)
            trial = lo - 0.5 * (hi - lo) + rng.random((population, d)) * 2 * (hi - lo)
            change = rng.random((population, d)) < 0.2
            trial = np.where(change, trial + rng.normal(0, 0.1, (population, d)) * (high - low), trial)
            trial[0] = best
        elif method == "pso":
            speed = 0.729 * speed + 1.49445 * rng.random((population, d)) * (own - x) + 1.49445 * rng.random((population, d)) * (best - x)
            trial = x + speed
        elif method == "gwo":
            a = 2 * (1 - g / max(1, generations))
            lead = x[np.argsort(-y)[:3]]
            trial = np.mean([w - (2 * a * rng.random((population, d)) - a) * np.abs(2 * rng.random((population, d)) * w - x) for w in lead], 0)
        elif method == "sa":
            trial = x + rng.normal(0, 0.1, (population, d)) * (high - low)
        else:
            raise ValueError(f"unknown method {method}")
        trial = np.clip(trial, low, high)
        new = values(trial)
        if method == "de":
            taken = new >= y
        elif method == "sa":
            heat = 0.1 * 0.001 ** (g / max(1, generations))
            taken = (new >= y) | (rng.random(population) < np.exp(np.minimum(0, (new - y) / heat)))
        else:
            taken = np.ones(population, bool)
        x, y = np.where(taken[:, None], trial, x), np.where(taken, new, y)
        better = y > own_y
        own, own_y = np.where(better[:, None], x, own), np.where(better, y, own_y)
        if y.max() > top:
            best, top = x[y.argmax()].copy(), float(y.max())
    return best.tolist(), top
