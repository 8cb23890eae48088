"""Rasters as a Spark data source: many tasks read byte ranges of one file, and many tasks write one raster.

``spark.read.format("raster")`` reads raw row-major rasters: a folder with meta.json (width, height) and a file ``<layer>.<kind>`` or a folder ``<layer>`` of bands for each layer. Each task
reads a band of rows of all layers it is asked for, and of those only the rows and columns of the window, which comes from the option ``window`` or from filters on x and y.

``write`` puts cells into bands of rows. A task stages its bands under names of its own; the commit moves those of the attempts that Spark counts into place and writes meta.json last,
so readers see a whole raster or none, and an attempt that failed leaves nothing. Bands in the order of their names are the raw file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a layer that a task reads, about; kinds of samples.
CHUNK_BYTES = 8 << 20
KINDS = {"f32": ("<f4", "float"), "u8": ("u1", "short")}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Layer:
    """Where a layer's rows are: (first row, rows, file) of each of its files."""

    name: str
    kind: str
    files: tuple[tuple[int, int, str], ...]


@dataclass
class Band(InputPartition):
    y0: int
    y1: int

    def __init__(self, y0: int, y1: int):
        super().__init__((y0, y1))
        self.y0, self.y1 = y0, y1


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.store, self.root = _store(self.path)
        with self.store.open_input_stream(f"{self.root}/meta.json") as f:
            meta = json.loads(f.read())
        self.width, self.height = int(meta["width"]), int(meta["height"])
        self.names = [n for n in options["layers"].split(",") if n]
        self.chunk = int(options.get("chunk", CHUNK_BYTES))
        x0, y0, x1, y1 = map(int, options["window"].split(",")) if "window" in options else (0, 0, self.width, self.height)
        self.x0, self.y0, self.x1, self.y1 = max(0, x0), max(0, y0), min(self.width, x1), min(self.height, y1)
        self.layers = [self._layer(n) for n in self.names]

    def _layer(self, name: str) -> Layer:
        for kind, (code, _) in KINDS.items():
            row = self.width * np.dtype(code).itemsize
            one = self.store.get_file_info(f"{self.root}/{name}.{kind}")
            if one.type == fs.FileType.File:
                found = [one]
            else:
                selected = self.store.get_file_info(fs.FileSelector(f"{self.root}/{name}", allow_not_found=True))
                found = sorted((f for f in selected if f.path.endswith(f".{kind}")), key=lambda f: f.path)
            if found:
                if sum(f.size for f in found) != row * self.height or any(f.size % row for f in found):
                    raise ValueError(f"{name}: {sum(f.size for f in found)} bytes instead of {row * self.height}")
                firsts = np.cumsum([0, *(f.size // row for f in found)])
                return Layer(name, kind, tuple((int(a), int(b - a), f.path) for a, b, f in zip(firsts, firsts[1:], found, strict=False)))
        raise ValueError(f"{self.path} has no layer {name}")

    def partitions(self) -> list[InputPartition]:
        rows = max(1, self.chunk // (self.width * 4))
        if self.x0 >= self.x1 or self.y0 >= self.y1:
            return [Band(0, 0)]
        return [Band(y, min(self.y1, y + rows)) for y in range(self.y0, self.y1, rows)]

    def _rows(self, layer: Layer, y0: int, y1: int) -> np.ndarray:
        """The window's columns of rows y0 to y1: whole rows in one read, or row by row where the window takes up a small part of them."""
        code = np.dtype(KINDS[layer.kind][0])
        out = np.empty((y1 - y0, self.x1 - self.x0), code)
        narrow = 8 * (self.x1 - self.x0) < self.width
        for first, rows, path in layer.files:
            a, b = max(y0, first), min(y1, first + rows)
            if a >= b:
                continue
            with self.store.open_input_file(path) as f:
                if narrow:
                    for y in range(a, b):
                        out[y - y0] = np.frombuffer(f.read_at(out.shape[1] * code.itemsize, ((y - first) * self.width + self.x0) * code.itemsize), code)
                else:
                    raw = f.read_at((b - a) * self.width * code.itemsize, (a - first) * self.width * code.itemsize)
                    out[a - y0 : b - y0] = np.frombuffer(raw, code).reshape(b - a, self.width)[:, self.x0 : self.x1]
        return out

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 18) // max(1, self.x1 - self.x0))
        for y0 in range(partition.y0, partition.y1, step):
            y1 = min(partition.y1, y0 + step)
            y, x = np.mgrid[y0:y1, self.x0 : self.x1].astype(np.int32)
            values = [self._rows(layer, y0, y1).ravel() for layer in self.layers]
            values = [pa.array(v.astype(np.int16) if v.dtype.kind == "u" else v) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(x.ravel()), pa.array(y.ravel()), *values], names=["x", "y", *self.names])


class FilteredReader(RasterReader):
    """The reader for sessions in which spark.sql.python.filterPushdown.enabled is on; in others Spark refuses readers that take filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of x and y narrow the window; all else is left to Spark."""
        for f in filters:
            axis = f.attribute[0] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("x",), ("y",)) and isinstance(f.value, int) else None
            if axis is None:
                yield f
                continue
            low, high = f"{axis}0", f"{axis}1"
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                setattr(self, low, max(getattr(self, low), f.value + isinstance(f, GreaterThan)))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                setattr(self, high, min(getattr(self, high), f.value + (not isinstance(f, LessThan))))


@dataclass
class Staged(WriterCommitMessage):
    """Bands (layer, band, file) that an attempt has staged."""

    files: list[tuple[str, int, str]]


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"].rstrip("/")
        self.width, self.height, self.band = int(options["width"]), int(options["height"]), int(options["band"])
        self.kind, self.fill = options.get("kind", "f32"), float(options.get("fill", "nan" if options.get("kind", "f32") == "f32" else "0"))
        self.layers = [n for n in schema.names if n not in ("x", "y")]
        self.job = uuid.uuid4().hex

    @property
    def stage(self) -> str:
        return f"{_store(self.path)[1]}/_staged-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """Rows come sorted by y, so one band is held at a time. Rows without x stand for a band that may have no cells."""
        store, root = _store(self.path)
        store.create_dir(self.stage)
        attempt, files, held, at = uuid.uuid4().hex, [], None, -1

        def close() -> None:
            for name, values in (held or {}).items():
                path = f"{self.stage}/{name}-{at:09d}-{attempt}"
                with store.open_output_stream(path) as f:
                    f.write(values.tobytes())
                files.append((name, at, path))

        for batch in iterator:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            cuts = np.flatnonzero(np.diff(y // self.band)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(y)], strict=True):
                if a == b:
                    continue
                if y[a] // self.band != at:
                    close()
                    at = int(y[a] // self.band)
                    rows = min(self.height, (at + 1) * self.band) - at * self.band
                    held = {n: np.full((rows, self.width), self.fill, KINDS[self.kind][0]) for n in self.layers}
                some = np.flatnonzero(~np.isnan(x[a:b].astype(float))) + a
                for n in self.layers:
                    v = batch.column(n).to_numpy(zero_copy_only=False)[some].astype(float)
                    held[n][y[some] - at * self.band, x[some].astype(int)] = np.where(np.isnan(v), self.fill, v)
        close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves the bands into place; only names pass here."""
        store, root = _store(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        bands = -(-self.height // self.band)
        if len(files) != len({f[:2] for f in files}) or len(files) != bands * len(self.layers):
            self.abort(messages)
            raise ValueError(f"{len(files)} bands instead of {bands * len(self.layers)}")
        for name in self.layers:
            store.create_dir(f"{root}/{name}")
        for name, band, path in files:
            store.move(path, f"{root}/{name}/{band * self.band:09d}.{self.kind}")
        with store.open_output_stream(f"{root}/meta.json") as f:
            f.write(json.dumps({"width": self.width, "height": self.height}).encode())
        store.delete_dir(self.stage)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _ = _store(self.path)
        if store.get_file_info(self.stage).type == fs.FileType.Directory:
            store.delete_dir(self.stage)


class RasterSource(DataSource):
    """Options: path, layers (names with commas), window (x0,y0,x1,y1, half open), chunk (bytes); for writing width, height, band, kind (f32 or u8), fill; filters (true where the session pushes them down)."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        reader = RasterReader(dict(self.options))
        return "x int, y int, " + ", ".join(f"`{layer.name}` {KINDS[layer.kind][1]}" for layer in reader.layers)

    def reader(self, schema: StructType) -> RasterReader:
        return (FilteredReader if self.options.get("filters") == "true" else RasterReader)(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(dict(self.options), schema)


def read_raster(spark: SparkSession, path: str, layers: list[str], window: tuple[int, int, int, int] | None = None, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(x, y, layers...) of the rasters in a folder, of the window (x0, y0, x1, y1) only if given. Layers that are not asked for are not read."""
    spark.dataSource.register(RasterSource)
    pushed = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    reader = spark.read.format("raster").option("layers", ",".join(layers)).option("chunk", chunk).option("filters", pushed)
    return (reader if window is None else reader.option("window", ",".join(map(str, window)))).load(path)


def write_raster(cells: DataFrame, path: str, width: int, height: int, layers: list[str], kind: str = "f32", band: int | None = None, fill: float | None = None) -> None:
    """cells (x, y, layers...) as a raster of the given size; cells outside are left out, places without a cell get fill (NaN, or 0 for u8). Of cells that stand twice any counts."""
    spark = cells.sparkSession
    spark.dataSource.register(RasterSource)
    band = band or max(1, CHUNK_BYTES // (4 * width))
    held = cells.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select(F.col("x").cast("int"), F.col("y").cast("int"), *[F.col(f"`{n}`").cast("double").alias(n) for n in layers])
    empty = spark.range(0, height, band).select(F.lit(None).cast("int").alias("x"), F.col("id").cast("int").alias("y"), *[F.lit(None).cast("double").alias(n) for n in layers])
    rows = held.unionByName(empty).withColumn("__band", F.expr(f"y div {band}")).repartition("__band").sortWithinPartitions("__band").drop("__band")
    writer = rows.write.format("raster").mode("append").option("width", width).option("height", height).option("band", band).option("kind", kind)
    (writer if fill is None else writer.option("fill", fill)).save(path)
