"""Text sinks and sources of series, parameter tables, ensembles and checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def series_lines(series: DataFrame, reporters: list[str]) -> DataFrame:
    """(step, line): CSV lines of a series; a reporter without a value at a step leaves its field empty."""
    fields = [F.coalesce(F.col(r).cast("string"), F.lit("")) for r in reporters]
    return series.select("step", F.concat_ws(",", F.col("step").cast("string"), *fields).alias("line"))


def write_series(series: DataFrame, path: str) -> None:
    series.write.mode("overwrite").csv(path, header=True)


def read_parameters(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(idx, names...) of headerless CSV files of doubles; idx is the number of the line, from 0, over the files in the order of their names.

    Lines are numbered within the blocks that Spark reads side by side; only the blocks' sizes are put in order.
    """
    rows = spark.read.csv(path, schema=", ".join(f"`{n}` double" for n in names))
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    blocks = rows.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__file", "__block")) - F.col("__n")
    return rows.join(blocks.withColumn("__before", before), ["__file", "__block"]).select((F.col("__id") - F.col("__first") + F.col("__before")).alias("idx"), *names)


def write_losses(losses: DataFrame, path: str, value: str = "loss") -> None:
    """A line with six decimals for each row of losses (idx, value), in the order of idx: files in the order of their names."""
    losses.repartitionByRange("idx").sortWithinPartitions("idx").select(F.format_string("%.6f", value).alias("line")).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """The results (method, run, best, evals) of optimiser runs as CSV with a heading, by method and run."""
    ordered = results.repartitionByRange("method", "run").sortWithinPartitions("method", "run")
    ordered.select("method", "run", F.format_string("%.6f", "best").alias("best"), "evals").write.mode("overwrite").csv(path, header=True)


def write_best(results: DataFrame, names: list[str], path: str, value: str = "best") -> None:
    """The parameters names and the value of the best of results as one JSON line."""
    top = results.agg(F.max_by(F.struct(*names, value), value).alias("b")).select("b.*")
    top.coalesce(1).write.mode("overwrite").json(path)


def read_ensemble(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """(seed, ...) of one CSV with header per seed, the seed being the last number in the file's name, or in that of the folder that holds a seed's part files."""
    rows = spark.read.csv(pattern, header=True, schema=schema)
    name = F.regexp_replace(F.input_file_name(), r"/part-[^/]*$", "")
    return rows.withColumn("seed", F.regexp_extract(name, r"(\d+)[^\d/]*$", 1).cast("long"))


def save_checkpoint(tables: dict[str, DataFrame], state: dict, path: str) -> None:
    """State tables as Parquet beside one JSON row of seed, steps and schedule."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = table.sparkSession
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def load_checkpoint(spark: SparkSession, names: list[str], path: str) -> tuple[dict[str, DataFrame], dict]:
    state = json.loads(spark.read.text(f"{path}/state").first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, state
