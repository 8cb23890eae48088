"""Raster stacks of a folder, and windows of them; the data source behind it reads and writes by byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from agentframe.sources.raster_source import read_raster, write_raster


def read_meta(spark: SparkSession, folder: str) -> Row:
    """The fields of folder/meta.json: width and height, and pixel_size and window (row_start, row_end, col_start, col_end) where it has them."""
    return spark.read.option("multiline", True).json(f"{folder}/meta.json").first()


def read_stack(spark: SparkSession, folder: str, layers: list[str]) -> DataFrame:
    """(x, y, <layer>...) of the rasters named in folder/meta.json (width, height): a row has all layers, without a join."""
    return read_raster(spark, folder, layers)


def read_window(spark: SparkSession, folder: str, layers: list[str]) -> DataFrame:
    """(x, y, px, py, <layer>...): the stack with each cell's middle in map units, rows and columns counted in the full raster that meta.json's window is cut from."""
    meta = read_meta(spark, folder)
    at = lambda c, first: (F.col(c) + first + 0.5) * float(meta.pixel_size)
    return read_stack(spark, folder, layers).withColumns({"px": at("x", meta.window.col_start), "py": at("y", meta.window.row_start)})


def window(cells: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """The cells of a window of a raster, counted from its corner."""
    inside = F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)
    return cells.where(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def write_footprint(cells: DataFrame, path: str, width: int, height: int) -> None:
    """A raster of bytes, 1 where cells (x, y) has a cell, 0 elsewhere, as the layer footprint in the folder path."""
    write_raster(cells.select("x", "y", F.lit(1).alias("footprint")), path, width, height, ["footprint"], kind="u8")
