"""Series and panels: reporters are aggregates or column expressions over a state that has its step as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentframe.operators.ranks import tie_counts


def every(df: DataFrame, stride: int) -> DataFrame:
    """The steps that a collector with this stride keeps."""
    if stride <= 0:
        raise ValueError("a stride is positive")
    return df.where(F.col("step") % stride == 0)


def series(state: DataFrame, reporters: dict[str, Column]) -> DataFrame:
    """(step, reporters...) as doubles: one aggregation for all steps."""
    return state.groupBy("step").agg(*[c.cast("double").alias(n) for n, c in reporters.items()])


def panel(state: DataFrame, keys: list[str], reporters: dict[str, Column]) -> DataFrame:
    """(keys, reporter, value): a row for each agent, step and reporter; no reporters, no rows."""
    if not reporters:
        return state.select(*keys, F.lit("").alias("reporter"), F.lit(0.0).alias("value")).limit(0)
    pairs = F.array(*[F.struct(F.lit(n).alias("reporter"), c.cast("double").alias("value")) for n, c in reporters.items()])
    return state.select(*keys, F.inline(pairs))


def gini(df: DataFrame, group: str, wealth: str) -> DataFrame:
    """(group, gini) of non-negative integers; 0 for no wealth. Equal values are ranked together, different ones over range partitions."""
    ranked = tie_counts(df, [group], wealth)
    ranks = F.col("upto") * (F.col("upto") + 1) - (F.col("upto") - F.col("n")) * (F.col("upto") - F.col("n") + 1)
    total = ranked.withColumn("ranks", ranks).groupBy(group).agg(F.sum(F.col("ranks").cast("decimal(38,0)") * F.col(wealth)).alias("a"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col(wealth)).alias("s"))
    value = (F.col("a").cast("double") - (F.col("n") + 1).cast("double") * F.col("s")) / (F.col("n").cast("double") * F.col("s"))
    return total.select(group, F.when(F.col("s") == 0, 0.0).otherwise(value).alias("gini"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) with equal widths from 0 to the maximum, empty bins included."""
    top = df.agg(F.max(value).alias("top"))
    counted = df.crossJoin(F.broadcast(top)).select(F.expr(f"cast({value} * {bins} div (top + 1) as int)").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
