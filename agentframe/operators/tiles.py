"""Rasters in tiles: a row holds a square of cells as arrays, and stencils of any reach cost one exchange of the tiles' edges.

A tile sends each tile that its cells are within reach of one piece: nine pieces a tile while the reach is at most a side, whatever the reach is. With
the pieces put together, window sums come from a summed-area table and window extremes from sliding extremes along both axes, so time does not depend on the window either.
Several steps of diffusion take one exchange of as many rows of cells. Cells that are missing or null count as such (NaN in the arrays).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from agentframe.operators.grid import MOORE, GridSpec


@dataclass(frozen=True)
class Tiling:
    spec: GridSpec
    side: int = 256

    def __post_init__(self):
        if self.side <= 0:
            raise ValueError("a tile needs a side")

    def span(self, t: int, size: int) -> tuple[int, int]:
        """First cell of tile t along an axis of size cells, and the one after its last."""
        return t * self.side, min((t + 1) * self.side, size)

    def reached(self, t: int, size: int, before: int, after: int) -> list[tuple[int, int, int, int]]:
        """(tile, first, end, shift): the tiles along one axis whose cells, with margins before and after, take in cells first to end of tile t; shift takes those cells beside the tile on a torus."""
        a, b = self.span(t, size)
        found, last = [], (size - 1) // self.side
        for shift in (-size, 0, size) if self.spec.torus else (0,):
            low, high = max(0, (a + shift - after) // self.side), min(last, (b + shift + before) // self.side)
            for u in range(low, high + 1):
                c, d = self.span(u, size)
                first, end = max(a + shift, c - before), min(b + shift, d + after)
                if first < end:
                    found.append((u, first - shift, end - shift, shift))
        return found


@dataclass(frozen=True)
class Reach:
    """The window's offsets along both axes: x0 to x1 and y0 to y1, ends included."""

    x0: int
    x1: int
    y0: int
    y1: int

    @staticmethod
    def of(spec: GridSpec, radius: int) -> Reach:
        """The square window; on a torus no dimension is spanned twice."""
        if radius < 0:
            raise ValueError("a radius is not negative")
        first = lambda n: -min(radius, n - 1) if spec.torus else -radius
        end = lambda n: min(radius, first(n) + n - 1) if spec.torus else radius
        return Reach(first(spec.width), end(spec.width), first(spec.height), end(spec.height))

    @property
    def margins(self) -> tuple[int, int, int, int]:
        """Cells needed before and after a tile, along x and along y."""
        return max(0, -self.x0), max(0, self.x1), max(0, -self.y0), max(0, self.y1)


def _schema(names: list[str]) -> StructType:
    return StructType([StructField("tx", IntegerType()), StructField("ty", IntegerType()), *(StructField(n, ArrayType(DoubleType())) for n in names)])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), pa.float64()))


def cut(cells: DataFrame, tiling: Tiling, *values: str) -> DataFrame:
    """(tx, ty, values as arrays in row-major order) of cells (x, y, values); one shuffle. Of cells that stand twice the last one counts."""
    side, spec = tiling.side, tiling.spec
    tile = [F.expr(f"cast(x div {side} as int)").alias("tx"), F.expr(f"cast(y div {side} as int)").alias("ty")]
    held = cells.where(F.col("x").between(0, spec.width - 1) & F.col("y").between(0, spec.height - 1)).select(*tile, F.struct("x", "y", *[F.col(v).cast("double").alias(v) for v in values]).alias("c"))
    grouped = held.groupBy("tx", "ty").agg(F.collect_list("c").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tx, ty, c = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values
                (a, b), (e, f) = tiling.span(tx, spec.width), tiling.span(ty, spec.height)
                at = (c.field("y").to_numpy() - e) * (b - a) + c.field("x").to_numpy() - a
                out = []
                for v in values:
                    one = np.full((b - a) * (f - e), np.nan)
                    one[at] = c.field(v).to_numpy(zero_copy_only=False)
                    out.append(one)
                yield pa.RecordBatch.from_arrays([pa.array([tx], pa.int32()), pa.array([ty], pa.int32()), *[_lists([o]) for o in out]], names=["tx", "ty", *values])

    return grouped.mapInArrow(run, _schema(list(values)))


def cells_of(tiles: DataFrame, tiling: Tiling) -> DataFrame:
    """(x, y, values) of all cells of which some value is there."""
    names = [c for c in tiles.columns if c not in ("tx", "ty")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (a, b), (e, f) = tiling.span(batch.column("tx")[k].as_py(), tiling.spec.width), tiling.span(batch.column("ty")[k].as_py(), tiling.spec.height)
                values = [batch.column(n)[k].values.to_numpy(zero_copy_only=False) for n in names]
                at = np.flatnonzero(~np.logical_and.reduce([np.isnan(v) for v in values]))
                arrays = [pa.array((at % (b - a) + a).astype(np.int32)), pa.array((at // (b - a) + e).astype(np.int32)), *[pa.array(v[at], from_pandas=True) for v in values]]
                yield pa.RecordBatch.from_arrays(arrays, names=["x", "y", *names])

    return tiles.mapInArrow(run, "x int, y int, " + ", ".join(f"`{n}` double" for n in names))


def stencil(tiles: DataFrame, tiling: Tiling, margins: tuple[int, int, int, int], work: Callable[..., dict[str, np.ndarray]], names: list[str], everywhere: bool = False) -> DataFrame:
    """(tx, ty, names...): work applied to each tile with margins (before and after along x, then along y) of its neighbours' cells.

    work gets the 2D arrays of the tile's values with margins, by name, and x0, y0, the cell in their corner (outside the grid where the margin is); it returns
    arrays of the tile's own size. Tiles that have no cells of their own are worked out only everywhere, where pieces reach them.
    """
    spec = tiling.spec
    if spec.torus and (max(margins[:2]) >= spec.width or max(margins[2:]) >= spec.height):
        raise ValueError("a margin spans the torus more than once")
    values = [c for c in tiles.columns if c not in ("tx", "ty")]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tx, ty = batch.column("tx")[k].as_py(), batch.column("ty")[k].as_py()
                (a, b), (e, f) = tiling.span(tx, spec.width), tiling.span(ty, spec.height)
                whole = [batch.column(v)[k].values.to_numpy(zero_copy_only=False).reshape(f - e, b - a) for v in values]
                rows = []
                for ux, x0, x1, sx in tiling.reached(tx, spec.width, *margins[:2]):
                    for uy, y0, y1, sy in tiling.reached(ty, spec.height, *margins[2:]):
                        rows.append((ux, uy, x0 + sx, y0 + sy, x1 - x0, int((ux, uy, sx, sy) == (tx, ty, 0, 0)), [w[y0 - e : y1 - e, x0 - a : x1 - a].ravel() for w in whole]))
                arrays = [pa.array([r[i] for r in rows], pa.int32()) for i in range(6)]
                yield pa.RecordBatch.from_arrays([*arrays, *[_lists([r[6][i] for r in rows]) for i in range(len(values))]], names=["tx", "ty", "px", "py", "pw", "own", *values])

    pieces = StructType([StructField(n, IntegerType()) for n in ("tx", "ty", "px", "py", "pw", "own")] + [StructField(v, ArrayType(DoubleType())) for v in values])

    def join(table: pa.Table) -> pa.Table:
        tx, ty = table.column("tx")[0].as_py(), table.column("ty")[0].as_py()
        (a, b), (e, f) = tiling.span(tx, spec.width), tiling.span(ty, spec.height)
        if not everywhere and not any(table.column("own").to_pylist()):
            return pa.table({"tx": pa.array([], pa.int32()), "ty": pa.array([], pa.int32()), **{n: pa.array([], pa.list_(pa.float64())) for n in names}})
        x0, y0 = a - margins[0], e - margins[2]
        held = {v: np.full((f - e + margins[2] + margins[3], b - a + margins[0] + margins[1]), np.nan) for v in values}
        at = [table.column(c).to_numpy() for c in ("px", "py", "pw")]
        for v in values:
            for k, piece in enumerate(table.column(v)):
                part = piece.values.to_numpy(zero_copy_only=False).reshape(-1, at[2][k])
                held[v][at[1][k] - y0 : at[1][k] - y0 + part.shape[0], at[0][k] - x0 : at[0][k] - x0 + part.shape[1]] = part
        out = work(held, x0, y0)
        return pa.table({"tx": pa.array([tx], pa.int32()), "ty": pa.array([ty], pa.int32()), **{n: _lists([np.asarray(out[n], np.float64).ravel()]) for n in names}})

    return tiles.mapInArrow(send, pieces).groupBy("tx", "ty").applyInArrow(join, _schema(names))


def window_sums(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Sums of all width x height rectangles of a, by a summed-area table."""
    table = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    np.cumsum(np.cumsum(a, axis=0), axis=1, out=table[1:, 1:])
    return table[height:, width:] - table[:-height, width:] - table[height:, :-width] + table[:-height, :-width]


def sliding_max(a: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Greatest of each n values in a row along axis: running maxima forwards and backwards within blocks of n, whatever n is."""
    a = np.moveaxis(a, axis, -1)
    size = a.shape[-1]
    least = np.iinfo(a.dtype).min if a.dtype.kind == "i" else -np.inf
    padded = np.concatenate([a, np.full((*a.shape[:-1], -size % n), least, a.dtype)], axis=-1)
    blocks = padded.reshape(*a.shape[:-1], -1, n)
    up = np.maximum.accumulate(blocks, axis=-1).reshape(padded.shape)
    down = np.maximum.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return np.moveaxis(np.maximum(down[..., : size - n + 1], up[..., n - 1 : size]), -1, axis)


def window_max(a: np.ndarray, width: int, height: int) -> np.ndarray:
    return sliding_max(sliding_max(a, width, 1), height, 0)


def _own(a: np.ndarray, margins: tuple[int, int, int, int]) -> np.ndarray:
    return a[margins[2] : a.shape[0] - margins[3], margins[0] : a.shape[1] - margins[1]]


def window_stats(tiles: DataFrame, tiling: Tiling, radius: int, value: str) -> DataFrame:
    """(tx, ty, n, sum, mean, least, most) of each cell's square window, itself included; missing cells are left out and get no window."""
    reach = Reach.of(tiling.spec, radius)
    margins, size = reach.margins, (reach.x1 - reach.x0 + 1, reach.y1 - reach.y0 + 1)

    def work(held: dict[str, np.ndarray], x0: int, y0: int) -> dict[str, np.ndarray]:
        a = held[value]
        there = ~np.isnan(a)
        cropped = lambda b: b[reach.y0 + margins[2] :, reach.x0 + margins[0] :]
        shape = _own(a, margins).shape
        fit = lambda b: b[: shape[0], : shape[1]]
        n, total = (fit(window_sums(cropped(b), *size)) for b in (there.astype(float), np.where(there, a, 0.0)))
        most, least = fit(window_max(cropped(np.where(there, a, -np.inf)), *size)), -fit(window_max(cropped(np.where(there, -a, -np.inf)), *size))
        own = _own(there, margins)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = {"n": n, "sum": total, "mean": total / n, "least": least, "most": most}
        return {k: np.where(own, v, np.nan) for k, v in out.items()}

    return stencil(tiles.select("tx", "ty", value), tiling, margins, work, ["n", "sum", "mean", "least", "most"])


def _numbered(a: np.ndarray) -> np.ndarray:
    """Cells numbered from 1 by value; of equal values the first by column, then row, has the greatest number; missing cells have 0."""
    y, x = np.indices(a.shape)
    order = np.lexsort((-y.ravel(), -x.ravel(), a.ravel()))
    number = np.empty(a.size, np.int64)
    number[order] = np.arange(1, a.size + 1)
    return np.where(np.isnan(a), 0, number.reshape(a.shape))


def _places(numbers: np.ndarray, at: np.ndarray, x0: int, y0: int, spec: GridSpec) -> tuple[np.ndarray, np.ndarray]:
    """The cells (x, y) that have the numbers at; NaN for 0."""
    place = np.zeros(numbers.size + 1, np.int64)
    place[numbers.ravel()] = np.arange(numbers.size)
    x, y = place[at] % numbers.shape[1] + x0, place[at] // numbers.shape[1] + y0
    if spec.torus:
        x, y = x % spec.width, y % spec.height
    return np.where(at > 0, x, np.nan), np.where(at > 0, y, np.nan)


def _around(numbers: np.ndarray, reach: Reach, shape: tuple[int, int]) -> np.ndarray:
    """Greatest number in each window without its middle: the rows above and below, and the two sides of the middle row."""
    margins = reach.margins
    best = np.zeros(shape, np.int64)
    for xs, ys in (((reach.x0, reach.x1), (reach.y0, -1)), ((reach.x0, reach.x1), (1, reach.y1)), ((reach.x0, -1), (0, 0)), ((1, reach.x1), (0, 0))):
        if xs[0] <= xs[1] and ys[0] <= ys[1]:
            part = window_max(numbers[ys[0] + margins[2] :, xs[0] + margins[0] :], xs[1] - xs[0] + 1, ys[1] - ys[0] + 1)
            best = np.maximum(best, part[: shape[0], : shape[1]])
    return best


def best_in_window(tiles: DataFrame, tiling: Tiling, radius: int, value: str) -> DataFrame:
    """(tx, ty, bx, by, best): the other cell of the square window with the greatest value; ties go to the first by column, then row. Missing cells are skipped and get none."""
    reach = Reach.of(tiling.spec, radius)

    def work(held: dict[str, np.ndarray], x0: int, y0: int) -> dict[str, np.ndarray]:
        a = held[value]
        numbers, own = _numbered(a), _own(a, reach.margins)
        at = np.where(np.isnan(own), 0, _around(numbers, reach, own.shape))
        bx, by = _places(numbers, at, x0, y0, tiling.spec)
        flat = np.full(a.size + 1, np.nan)
        flat[numbers.ravel()] = a.ravel()
        return {"bx": bx, "by": by, "best": np.where(at > 0, flat[at], np.nan)}

    return stencil(tiles.select("tx", "ty", value), tiling, reach.margins, work, ["bx", "by", "best"])


def lowest_or_flat(tiles: DataFrame, tiling: Tiling, radius: int, value: str, size: float, flattest: float = -0.05) -> DataFrame:
    """(tx, ty, bx, by, flat): the window's lowest cell where it is lower than the middle, else, with flat 1, the one nearest in height whose slope is not under flattest.

    Cells without either, and missing ones, get none. Ties go to the first by column, then row; size is the length of a cell's side.
    """
    reach = Reach.of(tiling.spec, radius)
    margins = reach.margins

    def work(held: dict[str, np.ndarray], x0: int, y0: int) -> dict[str, np.ndarray]:
        a = held[value]
        own = _own(a, margins)
        numbers = _numbered(-a)
        at = _around(numbers, reach, own.shape)
        height = np.full(a.size + 1, np.nan)
        height[numbers.ravel()] = a.ravel()
        with np.errstate(invalid="ignore"):
            down = (at > 0) & (height[at] < own)
        bx, by = _places(numbers, np.where(down, at, 0), x0, y0, tiling.spec)
        rest = np.flatnonzero(~down & ~np.isnan(own))
        ry, rx = rest // own.shape[1], rest % own.shape[1]
        v, near, to = own.ravel()[rest], np.full(len(rest), np.inf), np.full((2, len(rest)), np.nan)
        for dx in range(reach.x0, reach.x1 + 1) if len(rest) else ():
            for dy in range(reach.y0, reach.y1 + 1):
                if (dx, dy) != (0, 0):
                    other = a[ry + dy + margins[2], rx + dx + margins[0]]
                    with np.errstate(invalid="ignore"):
                        better = ((v - other) / (math.sqrt(dx * dx + dy * dy) * size) >= flattest) & (np.abs(other - v) < near)
                    near[better] = np.abs(other - v)[better]
                    to[0, better], to[1, better] = rx[better] + dx + margins[0] + x0, ry[better] + dy + margins[2] + y0
        if tiling.spec.torus:
            to[0], to[1] = to[0] % tiling.spec.width, to[1] % tiling.spec.height
        bx.ravel()[rest], by.ravel()[rest] = to
        flat = np.where(np.isnan(bx), np.nan, ~down)
        return {"bx": bx, "by": by, "flat": flat}

    return stencil(tiles.select("tx", "ty", value), tiling, margins, work, ["bx", "by", "flat"])


def diffuse(tiles: DataFrame, tiling: Tiling, value: str, rate: float, steps: int = 1, neighbourhood: str = MOORE) -> DataFrame:
    """(tx, ty, value) after steps of diffusion: each cell gives rate / 8 (or / 4) of its value to each neighbour there is. One exchange for all steps; missing cells hold 0."""
    spec = tiling.spec
    if not 0 <= rate <= 1:
        raise ValueError("rate outside [0, 1]")
    if spec.torus and (min(spec.width, spec.height) < 3 or steps >= min(spec.width, spec.height)):
        raise ValueError("the torus is too small for so many steps at once")
    shift = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0) and (neighbourhood == MOORE or 0 in (dx, dy))]
    margins = (steps,) * 4

    def around(a: np.ndarray) -> np.ndarray:
        padded = np.pad(a, 1)
        return sum(padded[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dx, dy in shift)

    def work(held: dict[str, np.ndarray], x0: int, y0: int) -> dict[str, np.ndarray]:
        a = np.nan_to_num(held[value])
        x, y = np.arange(a.shape[1]) + x0, np.arange(a.shape[0]) + y0
        inside = np.ones(a.shape) if spec.torus else np.outer((y >= 0) & (y < spec.height), (x >= 0) & (x < spec.width)).astype(float)
        given = around(inside) * inside
        for _ in range(steps):
            share = a * (rate / len(shift))
            a = a - share * given + around(share) * inside
        return {value: _own(a, margins)}

    return stencil(tiles.select("tx", "ty", value), tiling, margins, work, [value])


def disc(tiles: DataFrame, tiling: Tiling, radius: int, value: str) -> DataFrame:
    """(tx, ty, value): 1 in the cells less than radius away from a cell that has a value, NaN in all others; row by row, each with running counts."""
    margins = (max(0, radius - 1),) * 4

    def work(held: dict[str, np.ndarray], x0: int, y0: int) -> dict[str, np.ndarray]:
        marked = ~np.isnan(held[value])
        own = _own(marked, margins)
        found = np.zeros(own.shape, bool)
        for dy in range(-radius + 1, radius):
            half = math.isqrt(radius * radius - dy * dy - 1)
            rows = marked[dy + margins[2] : dy + margins[2] + own.shape[0]]
            upto = np.concatenate([np.zeros((rows.shape[0], 1), int), np.cumsum(rows, axis=1)], axis=1)
            first = np.arange(own.shape[1]) + margins[0] - half
            found |= upto[:, first + 2 * half + 1] > upto[:, first]
        return {value: np.where(found, 1.0, np.nan)}

    return stencil(tiles.select("tx", "ty", value), tiling, margins, work, [value], everywhere=True)
