"""Sources, sinks and raster preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agentframe.operators.quantiles import exact_quantiles
from agentframe.operators.streams import first_draws
from agentframe.plans.declare import query
from agentframe.plans.fixtures import ENS, GRID, HEIGHT, PANEL, WIDTH, ensemble, grid, grid_spec, panel, table
from agentframe.sources import raster, tables
from agentframe.sources.raster_source import read_raster, write_raster
from agentframe.sources.shared import shared_folder
from agentframe.sources.tables import series_lines
from agentframe.streaming.memory import run_to_table
from agentframe.streaming.windows import hourly_totals


@query(f"SELECT step, concat_ws(',', step::VARCHAR, n::VARCHAR, top::VARCHAR) AS line FROM (SELECT step, count(*) AS n, CAST(round(max(value) * 100) AS BIGINT) AS top FROM {PANEL} GROUP BY step)")
def io_series_csv(spark, sf_dir):
    series = panel(spark, sf_dir).groupBy("step").agg(F.count("*").alias("n"), F.round(F.max("value") * 100).cast("long").alias("top"))
    return series_lines(series, ["n", "top"])


@query(f"SELECT min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM {GRID} WHERE cap = 17")
def mask_window(spark, sf_dir):
    """The half-open window around the cells of a mask."""
    return grid(spark, sf_dir).where("cap = 17").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))


@query(f"WITH p AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM {GRID}) SELECT x, y, round(least(greatest((v - lo) / (hi - lo), 0), 1), 6) AS v FROM {GRID}, p")
def raster_percentile_norm(spark, sf_dir):
    """Values scaled between the 2nd and 98th percentiles and clipped."""
    cells = grid(spark, sf_dir)
    found = exact_quantiles(cells, [], "v", [0.02, 0.98])
    ends = found.agg(F.max(F.when(F.col("q") < 0.5, F.col("value"))).alias("lo"), F.max(F.when(F.col("q") > 0.5, F.col("value"))).alias("hi"))
    scaled = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return cells.crossJoin(F.broadcast(ends)).select("x", "y", F.round(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)), 6).alias("v"))


@query()
def rng_byte_stream(spark, sf_dir):
    """Random bytes for outside test batteries: 64 words of exact stream per seed."""
    return first_draws(spark.range(8).withColumnRenamed("id", "seed"), 64).select("seed", "k", F.hex("word").alias("bytes"))


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL")
def stream_hourly_totals(spark, sf_dir):
    """The events table read as a stream: totals in cents of the hours that the watermark has passed."""
    return hourly_totals(spark, sf_dir)


_FELT = "(SELECT event_id, user_id, epoch_us(ts) AS us, value * 10 AS x, CAST(event_id * 37 % 1000 AS DOUBLE) AS y, event_type = 'error' AS danger FROM events WHERE epoch_us(ts) // 1000 <= (SELECT max(epoch_us(ts) // 1000) FROM events) - 600000)"
_RISK = "CASE WHEN sqrt(pow(x - zx, 2) + pow(y - zy, 2)) < 400 THEN (1 - (us - since) / 604800e6) * (1 - sqrt(pow(x - zx, 2) + pow(y - zy, 2)) / 400) ELSE 0 END"


@query(
    f"""WITH e AS {_FELT}, z AS (SELECT e.event_id, e.x, e.y, e.us, d.x AS zx, d.y AS zy, d.us AS since, row_number() OVER (PARTITION BY e.event_id ORDER BY d.us DESC, d.event_id DESC) AS k FROM e JOIN e d ON d.user_id = e.user_id AND d.danger AND (d.us < e.us OR d.us = e.us AND d.event_id < e.event_id)),
    r AS (SELECT event_id, count(*) AS zones, sum({_RISK}) AS risk FROM z WHERE k <= 64 AND us - since < 604800000000 GROUP BY event_id) SELECT event_id, user_id, coalesce(zones, 0) AS zones, round(coalesce(risk, 0), 6) AS risk FROM e LEFT JOIN r USING (event_id)"""
)
def stream_danger_memory(spark, sf_dir):
    """The risk that each user feels at each event, from errors remembered for 168 hours, 64 at most: keyed state of a stream."""
    rows = lambda s: s.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") * 10).alias("x"), (F.col("event_id") * 37 % 1000).cast("double").alias("y"), (F.col("event_type") == "error").alias("danger"))
    felt = run_to_table(spark, sf_dir, "events*.parquet", rows)
    return felt.select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "zones", F.round("risk", 6).alias("risk"))


def _place(spark, name):
    return f"{shared_folder(spark)}/agentframe/{name}-{uuid.uuid4().hex}"


@query(f"SELECT x, y, round(v, 2) AS v, CAST(cap AS DOUBLE) AS cap FROM {GRID} WHERE x >= 3 AND x < 17 AND y >= 5 AND y < 60")
def raster_stack_window(spark, sf_dir):
    """The grid written as two raster layers in bands, and a window of both read back by byte ranges."""
    spec, place = grid_spec(spark, sf_dir), _place(spark, "stack")
    write_raster(grid(spark, sf_dir), place, spec.width, spec.height, ["v", "cap"], band=16)
    out = read_raster(spark, place, ["v", "cap"], (3, 5, 17, 60), chunk=4 * spec.width * 20).where("not isnan(v)")
    return out.select("x", "y", F.round(F.col("v").cast("double"), 2).alias("v"), F.col("cap").cast("double").alias("cap"))


@query(f"SELECT CAST(i % {WIDTH} AS INT) AS x, CAST(i // {WIDTH} AS INT) AS y, CAST(i IN (SELECT y * {WIDTH} + x FROM {GRID} WHERE cap = 17) AS INT) AS mark FROM (SELECT unnest(range({WIDTH} * {HEIGHT})) AS i)")
def raster_footprint(spark, sf_dir):
    """The footprint of a mask written as bytes and read back, all cells."""
    spec, place = grid_spec(spark, sf_dir), _place(spark, "footprint")
    raster.write_footprint(grid(spark, sf_dir).where("cap = 17"), place, spec.width, spec.height)
    return read_raster(spark, place, ["footprint"]).select("x", "y", F.col("footprint").cast("int").alias("mark"))


_LINES = "(SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, CAST(o_orderkey AS DOUBLE) AS a, o_totalprice AS b FROM orders WHERE o_orderkey % 3 = 0)"


@query(f"SELECT idx, printf('%.6f', round(a + b, 2)) AS loss FROM {_LINES}")
def io_parameter_losses(spark, sf_dir):
    """Parameters as headerless CSV, numbered by line as they are read; a loss a line, in their order, read back."""
    place = _place(spark, "parameters")
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(F.col("o_orderkey").cast("double"), "o_totalprice").write.csv(f"{place}/in")
    read = tables.read_parameters(spark, f"{place}/in", ["a", "b"])
    tables.write_losses(read.select("idx", F.round(F.col("a") + F.col("b"), 2).alias("loss")), f"{place}/out")
    return tables.read_parameters(spark, f"{place}/out", ["loss"]).select("idx", F.format_string("%.6f", "loss").alias("loss"))


_BEST = f"(SELECT config AS method, seed AS run, max(micro) AS micro, count(*) AS evals FROM {ENS} GROUP BY ALL)"


@query(f"SELECT method, run, round(micro / 1e6, 6) AS best, evals FROM {_BEST}")
def io_result_csv(spark, sf_dir):
    """Results of each method and run through their CSV."""
    place = _place(spark, "results")
    results = ensemble(spark, sf_dir).groupBy(F.col("config").alias("method"), F.col("seed").alias("run")).agg((F.max("micro") / 1e6).alias("best"), F.count("*").alias("evals"))
    tables.write_results(results, place)
    return spark.read.csv(place, header=True, schema="method string, run long, best double, evals long").select("method", "run", F.round("best", 6).alias("best"), "evals")


@query(f"SELECT method, run, micro / 1e6 AS best FROM {_BEST} ORDER BY micro DESC, method DESC, run DESC LIMIT 1")
def io_best_json(spark, sf_dir):
    """The best of all results through its JSON."""
    place = _place(spark, "best")
    results = ensemble(spark, sf_dir).groupBy(F.col("config").alias("method"), F.col("seed").alias("run")).agg((F.max("micro") / 1e6).alias("best"))
    tables.write_best(results.withColumn("score", F.struct("best", "method", "run")), ["method", "run", "best"], place, "score")
    return spark.read.schema("method string, run long, best double").json(place)


@query(f"SELECT x, y, v, 7 AS step FROM {GRID}")
def io_checkpoint_restore(spark, sf_dir):
    """State and schedule saved and loaded again."""
    place = _place(spark, "saved")
    tables.save_checkpoint({"cells": grid(spark, sf_dir).select("x", "y", "v")}, {"seed": 3, "step": 7}, place)
    saved, state = tables.load_checkpoint(spark, ["cells"], place)
    return saved["cells"].withColumn("step", F.lit(state["step"]))


@query(f"SELECT seed, step, CAST(sum(micro) AS BIGINT) AS micro FROM {ENS} WHERE config = 'view' GROUP BY ALL")
def io_ensemble_csv(spark, sf_dir):
    """One CSV a seed, written by seed and read back with the seed from the file's folder."""
    place = _place(spark, "runs")
    rows = ensemble(spark, sf_dir).where("config = 'view'").select("step", "micro", F.concat(F.lit("run_"), F.col("seed")).alias("name"))
    rows.repartition("name").write.partitionBy("name").csv(place, header=True)
    return tables.read_ensemble(spark, f"{place}/*", "step long, micro long").groupBy("seed", "step").agg(F.sum("micro").alias("micro"))
