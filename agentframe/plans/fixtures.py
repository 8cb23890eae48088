"""The driver's tables as rasters, points, graphs, agents, panels and ensembles; each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentframe.operators.grid import GridSpec
from agentframe.operators.space import SpaceSpec

WIDTH = 20
GRID = "(SELECT CAST(p_partkey % 20 AS INT) AS x, CAST(p_partkey // 20 AS INT) AS y, p_retailprice AS v, p_size AS cap FROM part)"
HEIGHT = "(SELECT CAST(count(*) // 20 AS INT) FROM part)"
POINTS = "(SELECT o_orderkey AS idx, ((o_custkey * 7919) % 100003) / CAST(100.003 AS DOUBLE) AS px, ((o_orderkey * 104729) % 100003) / CAST(100.003 AS DOUBLE) AS py FROM orders)"
CUSTOMERS = "(SELECT c_custkey AS idx, ((c_custkey * 7919) % 100003) / CAST(100.003 AS DOUBLE) AS px, ((c_custkey * 104729) % 100003) / CAST(100.003 AS DOUBLE) AS py FROM customer)"
NET = "(SELECT o_custkey AS src, 1000000 + l_suppkey AS dst, CAST(sum(l_quantity) AS BIGINT) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"
AGENTS = "(SELECT c_custkey AS idx, 0 AS gen, c_mktsegment AS grp, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS wealth FROM customer)"
PANEL = "(SELECT CAST((epoch_us(ts) - 1704067200000000) // 3600000000 AS BIGINT) AS step, user_id AS idx, value FROM events)"
ENS = "(SELECT *, micro / 1e6 AS v FROM (SELECT event_type AS config, user_id % 30 AS seed, CAST((epoch_us(ts) - 1704067200000000) // 86400000000 AS BIGINT) AS step, CAST((20000 * sum(CAST(round(value * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS BIGINT) AS micro FROM events GROUP BY ALL))"
CONF = "(SELECT doc_id, quality = 1 AS truth, toxic = 1 AS pred FROM labels)"
SPACE = SpaceSpec(1000.0, 1000.0, 10.0)
TORUS = SpaceSpec(1000.0, 1000.0, 10.0, torus=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % WIDTH).cast("int").alias("x"), F.expr(f"cast(p_partkey div {WIDTH} as int)").alias("y"), F.col("p_retailprice").alias("v"), F.col("p_size").alias("cap"))


def grid_spec(spark: SparkSession, sf_dir: str, torus: bool = False) -> GridSpec:
    return GridSpec(WIDTH, max(1, table(spark, sf_dir, "part").count() // WIDTH), torus)


def _places(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("idx"), (((F.col(b) * 7919) % 100003) / F.lit(100.003)).alias("px"), (((F.col(a) * 104729) % 100003) / F.lit(100.003)).alias("py"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(table(spark, sf_dir, "customer"), "c_custkey", "c_custkey")


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).agg(F.sum("l_quantity").cast("long").alias("w"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.lit(0).alias("gen"), F.col("c_mktsegment").alias("grp"), F.round(F.abs("c_acctbal") * 100).cast("long").alias("wealth"))


def _bin(width: int):
    return F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / width).cast("long")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(_bin(3600000000).alias("step"), F.col("user_id").alias("idx"), "value")


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(config, seed, step, micro, v): mean values in whole millionths, worked out from whole cents, so no order of additions changes them."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("config"), (F.col("user_id") % 30).alias("seed"), _bin(86400000000).alias("step"), "value")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    means = rows.groupBy("config", "seed", "step").agg(cents.alias("cents"), F.count("*").alias("n"))
    return means.select("config", "seed", "step", F.expr("(20000 * cents + n) div (2 * n)").alias("micro")).withColumn("v", F.col("micro") / 1e6)


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 1).alias("pred"))
