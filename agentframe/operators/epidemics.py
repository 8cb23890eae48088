"""SIR rasters run to their end, in bands of rows: a band is sent the rows beside it, so many steps take one exchange.

Draws are functions of (seed, step, agent), so the rows beside a band come out there as they do at home, one row fewer in each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.operators.grid import GridSpec
from agentframe.operators.meeting import _groups
from agentframe.sources.shared import settled

#: Steps for one exchange; cells of a band.
STEPS, CELLS = 32, 1 << 16
S, I, R = 1, 2, 3  # noqa: E741


def uniforms(seed: int, step: int, agent: np.ndarray) -> np.ndarray:
    """rng.uniform(rng.child_seed(seed, step, agent)) of an array."""
    fold = lambda w, n: w ^ (w >> np.uint64(n))
    z = np.uint64(rng._python_mix64(rng._python_mix64(seed ^ rng.GOLDEN) ^ step)) ^ agent.astype(np.uint64)
    z = fold(z, 30) * np.uint64(rng.MIX_A)
    z = fold(fold(z, 27) * np.uint64(rng.MIX_B), 31)
    return (z >> np.uint64(11)).astype(float) * 2.0**-53


def _beside(sick: np.ndarray, round_: bool) -> np.ndarray:
    """Sick Moore neighbours; the first and the last row are neighbours too where the band is the whole torus."""
    near = sick.astype(np.uint8)
    across = near + np.roll(near, 1, 1) + np.roll(near, -1, 1)
    if round_:
        return across + np.roll(across, 1, 0) + np.roll(across, -1, 0) - near
    out = across - near
    out[1:] += across[:-1]
    out[:-1] += across[1:]
    return out


def _advance(cells: np.ndarray, first: int, own: slice, run: int, spec: GridSpec, done: int, steps: int, seed: int, beta: float, gamma: float) -> np.ndarray:
    """Counts of S, I and R of the rows own after each of so many steps; cells, whose first row is the stated one of the torus, is changed in place."""
    catches = np.array([1 - (1 - beta) ** k for k in range(9)])
    flat, counts, whole = cells.reshape(-1), np.zeros((steps, 4), np.int64), own == slice(0, len(cells)) and len(cells) == spec.height
    for k in range(steps):
        sick = cells == I
        if sick.any():
            near = _beside(sick, whole).reshape(-1)
            at = np.flatnonzero((flat == I) | ((flat == S) & (near > 0)))
            agent = run * spec.width * spec.height + (first + at // spec.width) % spec.height * spec.width + at % spec.width
            changes = uniforms(seed, done + k, agent) < np.where(flat[at] == I, gamma, catches[near[at]])
            flat[at[changes]] += 1
        elif k:
            counts[k:] = counts[k - 1]
            break
        counts[k] = np.bincount(cells[own].reshape(-1), minlength=4)
    return counts[:, 1:]


def _packed(cells: DataFrame, spec: GridSpec, rows: int, bands: int) -> DataFrame:
    """(band, cells, seen): the codes of each band's rows one after the other, 0 where there is no cell, and how many are S, I and R."""
    band = F.least(F.expr(f"y div {rows}"), F.lit(bands - 1)).cast("long")
    code = F.when(F.col("status") == "S", S).when(F.col("status") == "I", I).when(F.col("status") == "R", R)
    coded = cells.where(f"x >= 0 and y >= 0 and x < {spec.width} and y < {spec.height}").select(band.alias("key"), F.col("x").cast("int"), F.col("y").cast("int"), code.cast("byte").alias("code")).where("code is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            key = t.column("key")[0].as_py()
            high = (spec.height if key == bands - 1 else (key + 1) * rows) - key * rows
            out = np.zeros(high * spec.width, np.int8)
            out[(t.column("y").to_numpy() - key * rows) * spec.width + t.column("x").to_numpy()] = t.column("code").to_numpy()
            yield pa.RecordBatch.from_pydict({"band": pa.array([key], pa.int64()), "cells": pa.array([out], pa.list_(pa.int8())), "seen": pa.array([np.bincount(out, minlength=4)[1:]], pa.list_(pa.int64()))})

    return coded.repartition(min(bands, 512), "key").sortWithinPartitions("key").mapInArrow(pack, "band long, cells array<tinyint>, seen array<long>")


def sir_to_the_end(cells: DataFrame, runs: DataFrame, spec: GridSpec, seed: int, beta: float, gamma: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, step, s, i, r) of one synchronous SIR raster (x, y, status) on a torus for each row of runs (run, by), from step 0 until nobody in the run is infected."""
    if not 0 < gamma <= 1 or not spec.torus:
        raise ValueError("infected cells of a torus recover at some time")
    keys = ("run", *by)
    rows = max(STEPS, CELLS // spec.width)
    bands = max(1, spec.height // rows)
    state = settled(_packed(cells, spec, rows, bands).crossJoin(F.broadcast(runs.select(*keys))).select(*keys, "band", "cells", "seen"))
    parts, done, edge = min(512, max(1, bands * runs.count())), 0, STEPS * spec.width

    def line(df: DataFrame, first: int) -> DataFrame:
        each = F.transform(F.expr("sequence(0, cast(size(seen) div 3 as int) - 1)"), lambda k: F.struct(*[F.get("seen", 3 * k + j).alias(c) for j, c in enumerate("sir")]))
        return df.select(*keys, F.posexplode(each).alias("k", "n")).select(*keys, (F.col("k") + first).cast("long").alias("step"), "n.*")

    def piece(band: Column, side: int, held: Column) -> Column:
        return F.struct(band.cast("long").alias("band"), F.lit(side).alias("side"), held.alias("cells"))

    series = line(state, 0)
    while state.agg(F.sum(F.element_at("seen", -2))).first()[0]:
        own = piece(F.col("band"), 0, F.col("cells"))
        before = piece(F.pmod(F.col("band") - 1, F.lit(bands)), 1, F.slice("cells", 1, edge))
        after = piece(F.pmod(F.col("band") + 1, F.lit(bands)), -1, F.slice("cells", -edge, edge))
        sent = state.select(*keys, F.inline(F.array(own, before, after) if bands > 1 else F.array(own)))
        met = sent.repartition(parts, "run", "band").groupBy(*keys, "band").agg(F.array_sort(F.collect_list(F.struct("side", "cells"))).alias("rows"))
        met = met.select(*keys, "band", F.flatten(F.transform("rows", lambda r: r["cells"])).alias("cells"))

        def advance(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
            margin = STEPS if bands > 1 else 0
            for batch in batches:
                for k in range(len(batch)):
                    held = batch.column("cells")[k].values.to_numpy().reshape(-1, spec.width).copy()
                    inner = slice(margin, len(held) - margin)
                    counts = _advance(held, batch.column("band")[k].as_py() * rows - margin, inner, batch.column("run")[k].as_py(), spec, done, STEPS, seed, beta, gamma)
                    columns = [*[batch.column(c).slice(k, 1) for c in (*keys, "band")], pa.array([held[inner].reshape(-1)], pa.list_(pa.int8())), pa.array([counts.reshape(-1)], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "band", "cells", "seen"])

        state = settled(met.mapInArrow(advance, state.schema))
        series, done = series.unionByName(line(state, done + 1)), done + STEPS
    sums = series.groupBy(*keys, "step").agg(*[F.sum(c).alias(c) for c in "sir"])
    left = F.lag("i").over(Window.partitionBy(*keys).orderBy("step"))
    return sums.withColumn("left", left).where("left is null or left > 0").select(*by, "step", *"sir")
